"""Message, path, name and category classifiers as column expressions.

Patterns use explicit letter, digit and underscore classes instead of word boundaries, so that they
mean the same in every engine, for accented text too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

# The vocabulary of bug and refactoring messages.
BUG_WORDS = (
    r"fix(es|ed|ing)?|bug(s|gy)?|defect(s|ive)?|fault(s|y)?|error(s)?|patch(es|ed|ing)?|resolv(e|es|ed|ing)?|crash(es|ed|ing)?|regression(s)?|"
    r"hotfix|bugfix|workaround|repair(ed|ing)?|typo(s)?|broken|failure(s)?|fail(s|ed|ing)?|null.?pointer|npe|exception|traceback|segfault|overflow"
)
BUG_REFERENCE = r"(fix(es|ed)?|close[sd]?|resolve[sd]?)\s*#\d+"
BUG_GROUPS = {
    "fix": ("fix", "fixed", "fixes", "fixing", "hotfix", "bugfix"),
    "bug": ("bug", "bugs", "buggy"),
    "error": ("error", "errors"),
    "defect": ("defect", "defects"),
    "issue": ("issue", "issues"),
    "anomaly": ("anomaly", "anomalies"),
}
REFACTOR_WORDS = (
    r"refactor(ed|ing|s)?|cleanup|clean.?up|rename(d|s|ing)?|reorganiz(e|ed|ing)|restructur(e|ed|ing)|simplif(y|ied|ies|ying)|"
    r"extract(ed|ing)?|inline(d|s)?|tidy(ing)?|reformat(ted|ting)?"
)
SKIP_PATHS = (
    r"__init__\.py$", r"setup\.py$", r"conftest\.py$", r"manage\.py$", r"/migrations?/", r"/tests?/", r"test_[^/]+\.py$", r"[^/]+_test\.py$",
    r"/docs?/", r"/examples?/", r"/vendor/", r"conf\.py$", r"__main__\.py$", r"/\.",
)

BUG_PATTERN = rf"(?im){START}({BUG_WORDS}){END}|^fix[\(:]|{START}{BUG_REFERENCE}"
REFACTOR_PATTERN = rf"(?i){START}({REFACTOR_WORDS}){END}"
REVERT_PATTERN = rf"(?i)^revert{END}"
SKIP_PATTERN = "|".join(SKIP_PATHS)


def group_pattern(group: str) -> str:
    return rf"(?i){START}({'|'.join(BUG_GROUPS[group])}){END}"


def is_bug_message(subject: Column) -> Column:
    return F.coalesce(subject, F.lit("")).rlike(BUG_PATTERN)


def bug_groups(subject: Column) -> dict[str, Column]:
    """One 0/1 column per keyword group."""
    s = F.coalesce(subject, F.lit(""))
    return {g: s.rlike(group_pattern(g)).cast("int") for g in BUG_GROUPS}


def is_refactor_message(subject: Column) -> Column:
    return F.coalesce(subject, F.lit("")).rlike(REFACTOR_PATTERN)


def is_revert(subject: Column) -> Column:
    return F.trim(F.coalesce(subject, F.lit(""))).rlike(REVERT_PATTERN)


def should_skip(path: Column) -> Column:
    """The patterns are searched for, not anchored: ``latest_x.py`` holds ``test_x.py``."""
    return path.rlike(SKIP_PATTERN)


def normalised_path(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def safe_repo_name(url: Column) -> Column:
    """Last part of a URL or path, without ``.git``, as a file-system name; ``repo`` if nothing is left."""
    tail = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"/+$", ""), r"\.git$", ""), "/"), -1)
    clean = F.regexp_replace(F.regexp_replace(tail, r"[^a-zA-Z0-9_-]", "_"), r"^[_-]+|[_-]+$", "")
    return F.when(clean == "", "repo").otherwise(clean)


def full_name_of(url: Column) -> Column:
    """``owner/repository`` of an address, null if there is none."""
    m = F.regexp_extract(url, r"[/:]([\w.-]+/[\w.-]+?)(?:\.git)?/?$", 1)
    return F.when(m != "", m)


def is_repo_url(url: Column, host: str = "git.example.org") -> Column:
    return F.coalesce(url, F.lit("")).rlike(rf"^https?://(www\.)?{host.replace('.', '[.]')}/[\w.-]+/[\w.-]+/?$")


# Category vocabulary: a parameter of the classifier. These defaults name the categories in order with
# the words that speak plainest for each; callers with a longer vocabulary pass their own.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "AI/ML": ("machine-learning", "deep-learning", "neural-network", "pytorch", "tensorflow", "keras", "nlp", "llm", "computer-vision", "transformers", "scikit-learn", "reinforcement-learning", "ai", "ml"),
    "Web": ("django", "flask", "fastapi", "web", "website", "http", "rest-api", "api", "html", "web-framework", "web-server", "graphql", "scraping"),
    "Data": ("pandas", "etl", "database", "sql", "csv", "data", "airflow", "data-engineering", "visualization", "charts", "warehouse", "analytics"),
    "DevOps/CLI": ("docker", "kubernetes", "devops", "cli", "ci-cd", "terminal", "ansible", "terraform", "command-line", "monitoring", "automation"),
    "Security": ("security", "vulnerability", "pentest", "malware", "cryptography", "encryption", "fuzzing", "exploit"),
    "Desktop": ("gui", "desktop", "tkinter", "pyqt", "pygame", "game-engine", "widgets"),
    "Mobile": ("android", "ios", "mobile", "mobile-app", "phone"),
    "Robotics": ("robotics", "ros", "drone", "slam", "lidar", "kinematics", "robot"),
}
FALLBACK = "Diger"


MAX_WORDS = 100_000


def vocabulary_of(words: DataFrame) -> dict[str, tuple[str, ...]]:
    """A vocabulary from a table (category, word, position): categories by their least position, then by name.

    The words become patterns in the plan, so more than ``MAX_WORDS`` raise.
    """
    rows = words.where("category is not null and word is not null").groupBy("category", "word").agg(F.min("position").alias("position")).limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError("the vocabulary is too large for patterns")
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["position"], r["category"], r["word"])):
        out.setdefault(r["category"], []).append(r["word"])
    return {c: tuple(w) for c, w in out.items()}


def category_pattern(words: tuple[str, ...]) -> str:
    alternatives = "|".join(w.replace("-", "[- ]").replace(".", "[.]") for w in words)
    return rf"(?i){START}({alternatives}){END}"


def category_text(name: Column, topics: Column | None, description: Column) -> Column:
    parts = ([F.array_join(topics, " ")] if topics is not None else []) + [description, F.regexp_replace(name, "[-_]", " ")]
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def categories(text: Column, vocabulary: dict[str, tuple[str, ...]] | None = None) -> Column:
    """All categories of a text in the vocabulary's order, or the fallback alone."""
    every = F.array(*[F.when(text.rlike(category_pattern(w)), F.lit(c)) for c, w in (vocabulary or CATEGORIES).items()])
    found = F.filter(every, lambda c: c.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit(FALLBACK))).otherwise(found)


def primary_category(cats: Column) -> Column:
    return F.coalesce(F.get(cats, F.lit(0)), F.lit(FALLBACK))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
