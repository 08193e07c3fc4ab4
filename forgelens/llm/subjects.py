"""Subject areas of projects, by a distributed latent Dirichlet model.

Each project's texts are words (description) and tags (topics). The subjects are the rows of a catalogue;
the model has one topic for each and one for words that say nothing. A topic gets its subject from what
hand labels and the catalogue's own words show of a term, not from lists: a term met mostly in projects
of one label gets prior counts in that topic, a term spread over all labels gets them in the background
(``evidence``; ``top_terms`` gives the table to inspect). Expectation maximisation then fits all
projects, labelled or not; labels, noisy as they are, only shift the topic priors of their projects.
The fitted model gives the topic proportions of every sentence and of the tags, and a project gets the
one or two subjects that its sentences show. Terms that fewer than ``KNOWN_IN`` projects hold, or that
speak for no topic, say nothing, nor does a sentence that consists of them in the main, so a text of unknown
words has no subject.

Bounds: words are hashed into ``BUCKETS`` buckets, so the model (buckets x topics doubles, 21 MB for 9
subjects) has the same size for any corpus; the driver holds the model, never documents. Labels beyond
``MAX_LABELS`` rows (taken in hash order) are not used; every project is read for fitting and every
project is assigned. A catalogue of more than ``MAX_SUBJECTS`` rows raises.

Defined cases: projects found twice count once per different text; null, blank and empty texts say
nothing, and a project without words gets ``Diger`` alone, which is a subject even if the catalogue
lacks it; labels the catalogue does not hold are not used; letter case, accents and dotless i are folded.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forgelens.session import cut

OTHER = "Diger"  # the subject of texts that show none
BUCKETS = 1 << 18
ROUNDS = 12
MAX_LABELS, MAX_SUBJECTS = 200_000, 1000
ALPHA, BACKGROUND_ALPHA, ETA = 0.08, 0.15, 0.02
LABEL_WEIGHT = 0.6
EVIDENCE = 4.0  # prior counts a labelled project gives a term that speaks for its label alone
KNOWN_IN, SPEAKS = 3, 0.5  # projects that must hold a term, and the share of one topic it must have
LEAST_KNOWN = 1 / 3  # of a sentence's terms must say something, else it shows no subject
WORD = regex.compile(r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*|\p{N}+")
SENTENCE = regex.compile(r"(?<=[.!?;])\s+|:\s+|\s[-–]\s|\n+")


def fold(text: str) -> str:
    t = unicodedata.normalize("NFKD", text.lower().replace("ı", "i").replace("ß", "ss"))
    return "".join(c for c in t if not unicodedata.combining(c))


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def tag(topic: str) -> str:
    return "#" + regex.sub(r"[\s_-]+", "-", fold(topic).strip())


def sentence_terms(description: str | None) -> list[list[str]]:
    """Folded words of each sentence; a hyphenated word also counts as its parts."""
    out = []
    for s in SENTENCE.split(fold(description or "")):
        words = [w for m in WORD.findall(s) for w in ([m, *m.split("-")] if "-" in m else [m])]
        if words:
            out.append(words)
    return out


def _terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for name, topics, description, votes in zip(pdf["full_name"], pdf["topics"], pdf["description"], pdf["votes"]):
            tags = sorted({tag(t) for ts in topics if ts is not None for t in ts if t and t.strip()})
            parts = [[bucket(t)] for t in tags]
            for d in sorted({d for d in description if d}):
                parts.extend([bucket(w) for w in s] for s in sentence_terms(d))
            flat = [w for p in parts for w in p]
            rows.append((name, flat, [len(p) for p in parts], len(tags), list(votes) if votes is not None else []))
        yield pd.DataFrame(rows, columns=["full_name", "terms", "lengths", "tags", "votes"])


def projects(discovery: DataFrame, labels: DataFrame) -> DataFrame:
    """(full_name, terms, lengths, tags, votes): buckets of all terms, the length of each part, tags first."""
    bounded = labels.select("full_name", "category").where("full_name is not null and category is not null").orderBy(F.xxhash64("full_name", "category")).limit(MAX_LABELS)
    votes = bounded.groupBy("full_name").agg(F.collect_list("category").alias("votes"))
    texts = discovery.where("full_name is not null").groupBy("full_name").agg(F.collect_set("topics").alias("topics"), F.collect_set("description").alias("description"))
    return texts.join(votes, "full_name", "left").mapInPandas(_terms, "full_name string, terms array<int>, lengths array<int>, tags int, votes array<string>")


def _padded(docs: list[np.ndarray], at_once: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(positions, term matrix, mask) of documents of like length, a bounded number of cells at a time."""
    order = np.argsort([len(d) for d in docs], kind="stable")
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * max(1, len(docs[order[j]])) <= at_once:
            j += 1
        take = order[i:j]
        width = max(1, max(len(docs[k]) for k in take))
        terms, mask = np.zeros((len(take), width), np.int64), np.zeros((len(take), width))
        for r, k in enumerate(take):
            terms[r, :len(docs[k])], mask[r, :len(docs[k])] = docs[k], 1
        yield take, terms, mask
        i = j


def infer(phi: np.ndarray, terms: np.ndarray, mask: np.ndarray, alpha: np.ndarray, steps: int = 20) -> np.ndarray:
    """Responsibilities (documents, terms, topics) under word probabilities ``phi``."""
    p = phi[terms] * mask[:, :, None]
    share = alpha / alpha.sum(axis=1, keepdims=True)
    r = p
    for _ in range(steps):
        r = p * share[:, None, :]
        r /= np.maximum(r.sum(axis=2, keepdims=True), 1e-300)
        r *= mask[:, :, None]
        share = alpha + r.sum(axis=1)
        share /= share.sum(axis=1, keepdims=True)
    return r


def _alphas(votes: list, subjects: list[str]) -> np.ndarray:
    a = np.full((len(votes), len(subjects) + 1), ALPHA)
    a[:, -1] = BACKGROUND_ALPHA
    for i, v in enumerate(votes):
        for c in v:
            if c in subjects:
                a[i, subjects.index(c)] += LABEL_WEIGHT
    return a


def _summed(docs: DataFrame, width: int, part) -> np.ndarray:
    """The sum over tasks of (bucket, counts) parts; at most BUCKETS rows reach the driver."""
    parts = docs.mapInPandas(part, "bucket int, counts array<double>")
    rows = parts.groupBy("bucket").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(width)]).toPandas()
    total = np.zeros((BUCKETS, width))
    total[rows["bucket"].to_numpy()] = rows[[f"c{k}" for k in range(width)]].to_numpy()
    return total


def _rows(total: np.ndarray) -> pd.DataFrame:
    used = np.flatnonzero(total.sum(axis=1))
    return pd.DataFrame({"bucket": used.astype(np.int32), "counts": list(total[used])})


def _seen(subjects: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per bucket: labelled projects by label (a project's labels share it), then all projects."""
    total = np.zeros((BUCKETS, len(subjects) + 1))
    for pdf in batches:
        for terms, votes in zip(pdf["terms"], pdf["votes"]):
            own = np.unique(np.asarray(terms, dtype=np.int64))
            total[own, -1] += 1
            known = [subjects.index(c) for c in votes if c in subjects]
            for k in known:
                total[own, k] += 1 / len(known)
    yield _rows(total)


def evidence(labelled: np.ndarray) -> np.ndarray:
    """Prior counts (buckets, topics) from labelled projects by term and label.

    A term counts for a label by its lift over the labels' own shares; the flatter its lifts, the more of
    its count goes to the background.
    """
    n = labelled.sum(axis=1, keepdims=True)
    base = np.maximum(labelled.sum(axis=0), 1e-9)
    base = base / base.sum()
    lift = (labelled + 0.5 * base) / (n + 0.5) / base
    share = lift / lift.sum(axis=1, keepdims=True)
    flat = -(share * np.log(np.maximum(share, 1e-12))).sum(axis=1, keepdims=True) / np.log(max(2, labelled.shape[1]))
    flat = np.clip((flat - 0.55) / 0.35, 0, 1)
    return EVIDENCE * np.hstack([labelled * share * (1 - flat), n * flat])


def prior(docs: DataFrame, catalogue: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """(prior counts, whether a bucket's terms are known) from labels, the catalogue's words and document counts."""
    subjects = [c for c, _ in catalogue]
    seen = _summed(docs, len(subjects) + 1, partial(_seen, subjects))
    p = ETA + evidence(seen[:, :-1])
    known = seen[:, -1] >= KNOWN_IN
    for k, (name, meaning) in enumerate(catalogue):
        for w in (w for s in sentence_terms(f"{name.replace('/', ' ')} {meaning}") for w in s):
            p[bucket(w), k] += 1
            known[bucket(w)] = True
    return p, known


def _expected(phi: np.ndarray, subjects: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((BUCKETS, phi.shape[1]))
    for pdf in batches:
        docs = [np.asarray(t, dtype=np.int64) for t in pdf["terms"]]
        votes = list(pdf["votes"])
        for take, terms, mask in _padded(docs):
            r = infer(phi, terms, mask, _alphas([votes[k] for k in take], subjects))
            np.add.at(total, terms.ravel(), r.reshape(-1, phi.shape[1]))
    yield _rows(total)


def fit(docs: DataFrame, catalogue: list[tuple[str, str]], rounds: int = ROUNDS) -> np.ndarray:
    """Word probabilities (buckets, topics), zero for terms that say nothing. Each round is one pass and one aggregate of at most BUCKETS rows."""
    subjects = [c for c, _ in catalogue]
    base, known = prior(docs, catalogue)
    counts = base
    sc = docs.sparkSession.sparkContext
    for _ in range(rounds):
        held = sc.broadcast((counts / counts.sum(axis=0, keepdims=True)).astype(np.float32))
        counts = base + _summed(docs, len(subjects) + 1, lambda it, h=held: _expected(h.value.astype(float), subjects, it))
        held.unpersist()
    share = counts / counts.sum(axis=1, keepdims=True)
    total = counts.sum(axis=0, keepdims=True)
    phi = counts / (total + 0.5 * total[:, :-1].mean())  # a small topic's words weigh no more than their share of it
    return phi * (known & (share.max(axis=1) >= SPEAKS))[:, None]


def decide(parts: np.ndarray, tags: int, subjects: list[str]) -> list[str]:
    """Subjects from the topic proportions of parts (tags first, then sentences).

    A sentence speaks for its leading subject when that has most of what is not background; tags speak
    together. The two subjects with most weight stay, the second if it has a part of its own.
    """
    k = len(subjects)
    score = np.zeros(k)
    for i in range(len(parts)):
        own = parts[i, :k]
        if own.sum() < (0.35 if i < tags else 0.9):
            continue
        best = int(own.argmax())
        if own[best] >= 0.6 * own.sum():
            score[best] += 1.0 if i < tags else 1.5 + 0.1 * own[best]
    score[subjects.index(OTHER)] = 0
    ranked = [int(i) for i in np.argsort(-score, kind="stable") if score[i] >= 0.9]
    return [subjects[i] for i in ranked[:2]] or [OTHER]


def _assign(phi: np.ndarray, subjects: list[str], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    says = phi.sum(axis=1) > 0
    for pdf in batches:
        names, pieces, owner = list(pdf["full_name"]), [], []
        for d, (terms, lengths) in enumerate(zip(pdf["terms"], pdf["lengths"])):
            terms, at = np.asarray(terms, dtype=np.int64), 0
            for n in lengths:
                piece = terms[at:at + n]
                told = piece[says[piece]]
                pieces.append(told if len(told) >= LEAST_KNOWN * n else told[:0])
                owner.append(d)
                at += n
        mass = np.zeros((len(pieces), phi.shape[1]))
        for take, terms, mask in _padded(pieces) if pieces else ():
            mass[take] = infer(phi, terms, mask, _alphas([[]] * len(take), subjects)).sum(axis=1)
        bounds = np.searchsorted(np.asarray(owner, dtype=np.int64), np.arange(len(names) + 1))
        out = [(name, s) for d, (name, tags) in enumerate(zip(names, pdf["tags"])) for s in decide(mass[bounds[d]:bounds[d + 1]], int(tags), subjects)]
        yield pd.DataFrame(out, columns=["full_name", "category"])


def assign(docs: DataFrame, phi: np.ndarray, subjects: list[str]) -> DataFrame:
    """(full_name, category): one or two subjects a project."""
    held = docs.sparkSession.sparkContext.broadcast(phi.astype(np.float32))
    return docs.mapInPandas(lambda it: _assign(held.value.astype(float), subjects, it), "full_name string, category string")


def catalogue_rows(catalogue: DataFrame) -> list[tuple[str, str]]:
    """(category, meaning) by name; more than MAX_SUBJECTS raise."""
    rows = catalogue.where("category is not null").groupBy("category").agg(F.max("meaning").alias("meaning")).orderBy("category").limit(MAX_SUBJECTS + 1).collect()
    if len(rows) > MAX_SUBJECTS:
        raise ValueError("a catalogue of subjects has at most 1000 rows")
    found = [(r["category"], r["meaning"] or "") for r in rows]
    return found if any(c == OTHER for c, _ in found) else [*found, (OTHER, "")]


def subjects(discovery: DataFrame, labels: DataFrame, catalogue: DataFrame) -> DataFrame:
    docs = cut(projects(discovery, labels))
    known = catalogue_rows(catalogue)
    return assign(docs, fit(docs, known), [c for c, _ in known])


def _word_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for topics, description in zip(pdf["topics"], pdf["description"]):
            rows.extend((tag(t),) for t in (topics if topics is not None else []) if t and t.strip())
            rows.extend((w,) for s in sentence_terms(description) for w in s)
        f = pd.DataFrame(rows, columns=["term"])
        f["bucket"] = [bucket(t) for t in f["term"]]
        yield f.astype({"bucket": "int32"})


def top_terms(discovery: DataFrame, labels: DataFrame, catalogue: DataFrame, n: int = 15) -> DataFrame:
    """(subject, rank, term, probability): what a person inspects to see that topics mean their subjects."""
    docs = cut(projects(discovery, labels))
    known = catalogue_rows(catalogue)
    phi = fit(docs, known)
    names = [c for c, _ in known] + ["background"]
    lead = [(s, int(r + 1), int(b), float(phi[b, k])) for k, s in enumerate(names) for r, b in enumerate(np.argsort(-phi[:, k], kind="stable")[:n]) if phi[b, k] > 0]
    ranks = docs.sparkSession.createDataFrame(lead, "subject string, rank int, bucket int, probability double")
    words = discovery.select("topics", "description").mapInPandas(_word_rows, "term string, bucket int").groupBy("bucket").agg(F.mode("term", True).alias("term"))
    return ranks.join(words, "bucket", "left").select("subject", "rank", "term", F.round("probability", 6).alias("probability"))
