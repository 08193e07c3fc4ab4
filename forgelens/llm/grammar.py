"""Source files that do not parse.

Every file is parsed by every supported grammar, likeliest language first by its tokens. A file that its
own grammar (the one its extension names) rejects has a wrong extension if another accepts it of which it
has tokens (a bare literal parses in several), and is corrupt if none does. ``parsed_as`` lists all that
accept it, so a file that its own grammar accepts but another language fits better shows as well; only
what breaks the own grammar is flagged.

Defined cases: null contents and other extensions give no verdict; an empty or blank Python,
JavaScript or TOML file is valid, an empty or blank JSON file is not; a leading byte order mark is
no fault; nesting too deep for the parser leaves a file ``undecided``, which is not flagged. Faults
beyond the grammar (unknown names, wrong types) do not count.
"""

from __future__ import annotations

import ast
import json
import symtable
import sys
import tomllib
import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.llm import jsgrammar

EXTENSIONS = {"py": "python", "js": "javascript", "json": "json", "toml": "toml"}


class TooDeep(Exception):
    """The parser ran out of stack or memory; nothing is known about the text."""


def parse_python(text: str) -> bool:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            symtable.symtable(text, "f", "exec")  # the parser without building Python objects for the tree
            return True
        except (SyntaxError, ValueError):
            pass
        except (RecursionError, MemoryError) as e:
            raise TooDeep from e
        try:
            ast.parse(text)  # what only the symbol table refuses is no fault of grammar
            return True
        except SyntaxError as e:
            if "too many nested" in str(e) or "too many statically nested" in str(e):
                raise TooDeep from e
            return False
        except ValueError:
            return False
        except (RecursionError, MemoryError) as e:
            raise TooDeep from e


def parse_javascript(text: str) -> bool:
    try:
        jsgrammar.check(text)
        return True
    except jsgrammar.JsSyntaxError:
        return False
    except RecursionError as e:
        raise TooDeep from e


def _no_constant(name: str) -> None:
    raise ValueError(name)


def parse_json(text: str) -> bool:
    try:
        json.loads(text, parse_constant=_no_constant, parse_int=len, parse_float=len)
        return True
    except ValueError:
        return False
    except RecursionError as e:
        raise TooDeep from e


def parse_toml(text: str) -> bool:
    try:
        tomllib.loads(text, parse_float=str)
        return True
    except (ValueError, TypeError):
        return False
    except RecursionError as e:
        raise TooDeep from e


GRAMMARS: dict[str, Callable[[str], bool]] = {"python": parse_python, "javascript": parse_javascript, "json": parse_json, "toml": parse_toml}

# Tokens that speak for a language, as they stand in a text after a line break; a text is ranked by their number, ties in this order.
CUES = {
    "python": ("\ndef ", "    def ", "\nclass ", "\nimport ", "\nfrom ", "elif ", "\n@", ":\n", "self.", "None"),
    "javascript": ("function", "const ", "let ", "var ", "=>", "===", ";\n", "\n//"),
    "json": ('":', "\n{", "\n}", "\n[", '{"', "},", "],"),
    "toml": ("\n[", ' = "', " = [", " = true", " = false", " = 0", " = 1", " = 2", " = 3", " = 4", " = 5", " = 6", " = 7", " = 8", " = 9"),
}


def ranked(text: str) -> dict[str, int]:
    """All languages with their number of cues in the text, most first."""
    lines = "\n" + text.replace("\r", "") + "\n"
    score = {k: sum(map(lines.count, cues)) for k, cues in CUES.items()}
    return dict(sorted(score.items(), key=lambda kv: -kv[1]))


def accepted(text: str) -> tuple[dict[str, int], list[str], list[str]]:
    """(cues by language, languages whose grammar accepts the text, languages whose parser gave up), likeliest first."""
    score = ranked(text)
    fits, deep = [], []
    for language in score:
        try:
            if GRAMMARS[language](text):
                fits.append(language)
        except TooDeep:
            deep.append(language)
    return score, fits, deep


def judged(text: str, language: str) -> tuple[str, str | None, list[str]]:
    """('valid' | 'wrong_extension' | 'corrupt' | 'undecided', the language it is in, all that accept it)."""
    text = text.removeprefix("\ufeff")
    score, fits, deep = accepted(text)
    if language in deep:
        return "undecided", None, fits
    if language in fits:
        return "valid", language, fits
    foreign = next((k for k in fits if score[k]), None) if text.strip() else None
    return ("wrong_extension", foreign, fits) if foreign else ("corrupt", None, fits)


def verdict(text: str, language: str) -> tuple[str, str | None]:
    return judged(text, language)[:2]


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4000))
    if hasattr(sys, "set_int_max_str_digits"):
        sys.set_int_max_str_digits(0)
    for pdf in batches:
        found = [judged(t, g) for t, g in zip(pdf["content_"], pdf["language"])]
        out = pdf[["file_id", "project_name", "language"]].copy()
        out["verdict"] = [v for v, _, _ in found]
        out["actual"] = [p for _, p, _ in found]
        out["parsed_as"] = [fits for _, _, fits in found]
        yield out


def verdicts(files: DataFrame) -> DataFrame:
    """(file_id, project_name, language, verdict, actual, parsed_as) of every file with content and a known extension.

    One pass over the files without any shuffle; parsing is the whole cost and spreads by input splits.
    """
    extension = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z0-9]+)$", 1))
    language = None
    for e, name in EXTENSIONS.items():
        language = F.when(extension == e, name) if language is None else language.when(extension == e, name)
    known = files.select("file_id", "project_name", F.col("content").alias("content_"), language.alias("language")).where("content_ is not null and language is not null")
    return known.mapInPandas(_verdicts, "file_id long, project_name string, language string, verdict string, actual string, parsed_as array<string>")


def flagged(files: DataFrame) -> DataFrame:
    return verdicts(files).where("verdict in ('wrong_extension', 'corrupt')").select("file_id")


def rates(files: DataFrame) -> DataFrame:
    """(project_name, language, files, flagged, wrong_extension, foreign, rate) per repository and language.

    ``foreign`` counts valid files that a likelier language accepts as well.
    """
    bad = F.col("verdict").isin("wrong_extension", "corrupt").cast("long")
    return verdicts(files).groupBy("project_name", "language").agg(
        F.count("*").alias("files"), F.sum(bad).alias("flagged"), F.sum((F.col("verdict") == "wrong_extension").cast("long")).alias("wrong_extension"),
        F.sum(((F.col("verdict") == "valid") & (F.get("parsed_as", F.lit(0)) != F.col("language"))).cast("long")).alias("foreign"),
    ).withColumn("rate", F.col("flagged") / F.col("files"))
