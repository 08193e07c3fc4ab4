"""Encoding with a public byte-level BPE vocabulary, by Spark's higher-order functions.

A text is cut into words by the vocabulary's pattern. ASCII words that are tokens are looked up in
a literal rank map and never leave their row, so frequent words cause no shuffle. All other words are
made distinct over the whole corpus, and a fold merges each one's bytes: the state is a string of
bracketed hex pieces, each step replaces the adjacent pair of lowest rank everywhere it stands (a pair
made by a merge always ranks higher than it, so this equals merging one pair at a time). The results
join back by word, and a document's pieces are put in order by position.

The rank map is a literal: an array of small maps, indexed by CRC-32 of the piece, so a lookup compares
about 12 keys. Its size is that of the vocabulary. Decoding concatenates the pieces.

A long word is first cut between bytes that no token holds side by side. No merge crosses such a place, so
the parts are folded on their own and the work for text without blanks stays near its length. A frequent
word that is no ASCII token meets in one key of the join; adaptive execution splits such partitions.

Defined cases: empty and null texts have the empty list of ids; strings that look like special tokens
are ordinary text; texts and words of any length are encoded whole;
rows with equal ids and texts are each encoded.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgelens.session import cut

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SLOTS = 1 << 11
PLAN_TEXT = 100_000  # characters of a plan description

# The pattern of the vocabulary, with white space as in Unicode.
_S = r"\p{IsWhite_Space}"
PATTERN = rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}++| ?\p{{N}}++| ?[^{_S}\p{{L}}\p{{N}}]++|{_S}+(?!\P{{IsWhite_Space}})|{_S}+"


LONG = 48  # bytes; longer words are cut before they are folded


@lru_cache(maxsize=4)
def _joined(path: str) -> bytes:
    """For each pair of bytes whether some token holds it within, as 65536 bytes of 0 or 1."""
    held = bytearray(65536)
    with open(path, "rb") as lines:
        for line in lines:
            raw = base64.b64decode(line.split()[0])
            for a, b in zip(raw, raw[1:]):
                held[a << 8 | b] = 1
    return bytes(held)


def _let(value: Column, body) -> Column:
    """Bind a value once: a lambda over a one-element array, as lambdas are interpreted and share nothing else."""
    return F.transform(F.array(value), body)[0]


def segments(word: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """The bytes of a word as hex, in parts that no merge can join: cut between bytes that stand side by side in no token."""
    def cut_up(b: Column) -> Column:  # substrings of binary values cost their own length only
        last = F.length(b) - 1
        joined = lambda i: F.substring(F.lit(_joined(path)), F.conv(F.hex(F.substring(b, i + 1, F.lit(2))), 16, 10).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
        marked = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.hex(F.substring(b, i + 1, F.lit(1))), F.when((i < last) & ~joined(i), F.lit("|")).otherwise(F.lit(""))))
        return F.when(F.length(b) > LONG, F.split(F.array_join(marked, ""), "[|]")).otherwise(F.array(F.hex(b)))

    return _let(F.encode(word, "UTF-8"), cut_up)


@lru_cache(maxsize=4)
def _tables(path: str) -> tuple[str, str, str]:
    """As JSON: ranks of whole words by text, ranks of pieces by hex, and the list of pieces."""
    words: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    hexes: list[dict[str, int]] = [{} for _ in range(SLOTS)]
    pieces: dict[int, str] = {}
    with open(path, "rb") as lines:
        for line in lines:
            token, number = line.split()
            raw, rank = base64.b64decode(token), int(number)
            pieces[rank] = piece = raw.hex().upper()
            hexes[zlib.crc32(piece.encode()) % SLOTS][piece] = rank
            if raw.isascii():  # words of other letters are folded; plan texts then stay one byte a character
                words[zlib.crc32(raw) % SLOTS][raw.decode()] = rank
    return json.dumps(words), json.dumps(hexes), json.dumps([pieces.get(i, "") for i in range(max(pieces) + 1)])


def _rank(piece: Column, slots_json: str) -> Column:
    slots = F.from_json(F.lit(slots_json), "array<map<string,int>>")  # foldable: a literal in the plan
    return F.try_element_at(F.get(slots, (F.crc32(piece) % SLOTS).cast("int")), piece)


def rank_of_word(word: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """The id of a word of ASCII characters that is a token as it stands, null otherwise."""
    return _rank(word, _tables(path)[0])


def rank_of(piece: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """The rank (and id) of a hex piece, null if it is no token."""
    return _rank(piece, _tables(path)[1])


def _pieces(state: Column) -> Column:
    return F.split(F.substring(state, F.lit(2), F.length(state) - 2), "><")


def merged(word_hex: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """The ids of a word given as hex of its bytes, by folding ranked merges."""

    def best(p: Column) -> Column:
        pairs = F.zip_with(
            F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1),
            lambda a, b: _let(F.concat(a, b), lambda ab: _let(rank_of(ab, path), lambda r: F.when(r.isNotNull(), F.struct(r.alias("rank"), F.concat(F.lit("<"), a, F.lit("><"), b, F.lit(">")).alias("pair"), F.concat(F.lit("<"), ab, F.lit(">")).alias("one"))))),
        )
        return F.when(F.size(p) > 1, F.array_min(pairs))

    def step(state: Column, _: Column) -> Column:
        replaced = _let(best(_pieces(state["w"])), lambda f: F.struct(
            F.when(f.isNull(), state["w"]).otherwise(F.replace(state["w"], f["pair"], f["one"])).alias("w"), f.isNull().alias("over")))
        return F.when(state["over"], state).otherwise(replaced)

    start = F.struct(F.regexp_replace(word_hex, "(..)", "<$1>").alias("w"), F.lit(False).alias("over"))
    folded = F.aggregate(F.sequence(F.lit(1), F.greatest((F.length(word_hex) / 2).cast("int") - 1, F.lit(1))), start, step)
    return F.transform(_pieces(folded["w"]), lambda p: rank_of(p, path))


def _shorten_plan_texts(spark: SparkSession) -> None:
    """Cut the texts that describe plans: the literal maps would stand in each of them, and the driver keeps many."""
    allowed = spark.conf.get("spark.sql.maxPlanStringLength").rstrip("bB")
    if not allowed.isdigit() or int(allowed) > PLAN_TEXT:
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_VOCABULARY, keep: Sequence[str] = ()) -> DataFrame:
    """(key, kept columns, ids): the ids of every row's text, without special tokens."""
    _shorten_plan_texts(documents.sparkSession)
    kept = [F.col(c).alias(f"kept_{i}") for i, c in enumerate(keep)]
    held = [f"kept_{i}" for i in range(len(keep))]
    base = documents.select(F.col(key).alias("k_"), F.coalesce(F.col(text), F.lit("")).alias("t_"), *kept)
    words = F.regexp_extract_all(F.col("t_"), F.lit(PATTERN), F.lit(0))
    looked = base.select("k_", *held, F.xxhash64("t_").alias("h_"), F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("word"), rank_of_word(w, path).alias("id"))).alias("ws"))
    there = F.filter("ws", lambda w: w["id"].isNotNull())
    hits = looked.select("k_", "h_", *held, F.transform(there, lambda w: w["pos"]).alias("at"), F.transform(there, lambda w: w["id"]).alias("ids"))
    missing = cut(looked.select("k_", "h_", F.explode(F.filter("ws", lambda w: w["id"].isNull())).alias("w")).select("k_", "h_", "w.pos", "w.word"))
    distinct = missing.select("word").distinct().select("word", segments(F.col("word"), path).alias("parts_"))
    folded = distinct.select("word", F.flatten(F.transform("parts_", lambda p: merged(p, path))).alias("ids"))
    back = missing.join(folded, "word").groupBy("k_", "h_").agg(F.collect_set(F.struct("pos", "ids")).alias("misses"))  # a set, as repeated rows have equal keys and texts
    own = F.zip_with("at", "ids", lambda p, i: F.struct(p.alias("pos"), F.array(i).alias("ids")))
    every = F.array_sort(F.concat(own, "misses"))
    ids = F.when(F.col("misses").isNull(), F.col("ids")).otherwise(F.flatten(F.transform(every, lambda x: x["ids"])))
    return hits.join(back, hits["k_"].eqNullSafe(back["k_"]) & (hits["h_"] == back["h_"]), "left").select(hits["k_"].alias(key), *[F.col(h).alias(c) for h, c in zip(held, keep)], ids.alias("ids"))


def decode(ids: Column, path: str = DEFAULT_VOCABULARY) -> Column:
    """The text of a list of ids: pieces concatenated as bytes, then read as UTF-8."""
    pieces = F.from_json(F.lit(_tables(path)[2]), "array<string>")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")
