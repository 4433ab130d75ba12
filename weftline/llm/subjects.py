"""Subject area of each document (problem 8).

A lexicon of weighted terms, matched by one automaton (longest match first) in every sentence. The curated terms are its core; around it
grows what stands in the same sentences: terms of one or two words that occur with one subject alone, learnt from all documents in two
rounds. Terms that several subjects share are dropped, whoever named them. Rarity is counted over all documents. A
sentence treats a subject if its terms' weights, times their rarity and normalised by the sentence's length, exceed a threshold; a document
has every subject whose share of sentences exceeds another. Both thresholds are calibrated a subject, on labels that took no part in the learning.

Texts are read once, into chunks of coded words; the chunks are in the shared folder, and all later passes read them.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weftline.llm.packed import row, unpacked
from weftline.llm.subject_terms import TERMS, terms
from weftline.session import cut_lineage

#: Characters of sentences in a chunk.
CHUNK_CHARS = 6_000_000
#: Learnt terms (the most frequent) that the lexicon holds; ``Learnt.dropped`` tells how many more there were.
MAX_TERMS = 200_000
MAX_SUBJECTS = 10_000
LEAST_SUPPORT = 5
LEAST_PURITY = 0.75
#: The share of a term's sentences that must have a subject at all.
LEAST_ASSIGNED = 0.6
#: The share of a word's sentences that show a phrase, from which on the phrase stands for the word.
WITHIN = 0.8
#: The nominal thresholds (what a sentence's score must reach, and the share of sentences), and where calibration may move them.
SCORE, SCORES = 0.12, (0.08, 0.12, 0.16)
SHARE, SHARES = 0.25, (0.16, 0.18, 0.2, 0.22, 0.25, 0.28)
#: Labels that all subjects together stand for in a subject's calibration, so that few labels of its own don't decide alone.
POOLED = 200
#: A subject counts in a sentence only with this share of the best one's score.
BESIDE = 0.5

_WORD = re.compile(r"[^\W\d_]+(?:['’‑-][^\W\d_]+)*")
_WORD_OR_END = re.compile(_WORD.pattern + r"|\n")
#: Sentence ends (not after an initial), line ends, cell ends. The signs come first, as that is what the matcher can look for.
_CUT = re.compile(r"[.!?…](?<=[^\s.][\w\"'”’»)\]].)[\"'”’»)\]]*\s+|\r+|\|")
_HIDDEN = re.compile("[­​‌‍⁠﻿]")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\s]*\)")
_BROKEN = re.compile("[ÃÂâ][\u0080-¿€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]")


def mend(text: str) -> str:
    """Hidden characters out, compatibility forms folded, UTF-8 that was read as a one-byte code put right where all of it is so."""
    if text.isascii():
        return text
    if _BROKEN.search(text):
        for code in ("cp1252", "latin-1"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except UnicodeError:
                continue
        else:
            # broken in part: mend the pieces that can be mended
            text = re.sub(r"[\u0080-ÿ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]{2,}", lambda m: _piece(m.group()), text)
    return unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).replace("’", "'")


def _piece(x: str) -> str:
    for code in ("cp1252", "latin-1"):
        try:
            return x.encode(code).decode("utf-8")
        except UnicodeError:
            continue
    return x


def _joined(words: list[str]) -> str:
    return " " + "  ".join(words) + " "  # every word has its own two blanks, so that neighbours don't share one


def sentence_lines(text: str) -> list[str]:
    """Each sentence, line or cell that has at least two words, its words joined for the matcher."""
    text = mend(text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    words = _WORD_OR_END.findall(_CUT.sub("\n", text.lower()))
    return [f" {x} " for s in "  ".join(words).split("\n") if "  " in (x := s.strip(" "))]


@dataclass
class Lexicon:
    """term -> (subject number, weight)"""

    subjects: list[str]
    weights: dict[str, tuple[int, float]]

    def automaton(self) -> ahocorasick.Automaton:
        """Terms to their numbers."""
        a = ahocorasick.Automaton()
        for i, t in enumerate(self.weights):
            a.add_word(_joined(t.split(" ")), i)
        a.add_word(" \0 ", -1)
        a.make_automaton()
        return a

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each term: its subject and weight."""
        return np.array([s for s, _ in self.weights.values()], np.int64), np.array([w for _, w in self.weights.values()], float)


def curated(subjects: list[str]) -> Lexicon:
    """The curated terms of the given subjects; terms that two subjects name belong to none."""
    owner: dict[str, set[int]] = {}
    weight: dict[str, float] = {}
    for i, s in enumerate(subjects):
        if s in TERMS:
            for t, w in terms(s).items():
                t = " ".join(_WORD.findall(t.lower()))
                owner.setdefault(t, set()).add(i)
                weight[t] = w
    return Lexicon(subjects, {t: (next(iter(o)), weight[t]) for t, o in owner.items() if len(o) == 1})


@dataclass
class Chunk:
    """Documents: their keys, labels (None: without any) and whether these are held out, their numbers of sentences; all sentences joined for the matcher,
    a line each, and as words: how many a sentence, the vocabulary, and the number of each word in it."""

    keys: list
    labels: list[list[str] | None]
    held: list[bool]
    n_lines: np.ndarray
    text: str
    n_words: np.ndarray
    vocabulary: list[str]
    words: np.ndarray


def coded(keys: list, labels: list, held: list[bool], n_lines: list[int], lines: list[str]) -> Chunk:
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(lines, pa.large_string())))
    code = split.flatten().dictionary_encode()
    return Chunk(
        keys, labels, held, np.array(n_lines, np.int32), "\n".join(lines), pc.list_value_length(split).to_numpy().astype(np.int32), code.dictionary.to_pylist(), code.indices.to_numpy().astype(np.int32)
    )


def read_documents(docs: DataFrame) -> DataFrame:
    """Chunks of documents (k, labels, text), written to the shared folder. The only pass over the texts. Half of the labelled documents, by a hash of
    the key, have their labels held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, held, n_lines, lines, size = [], [], [], [], [], 0
        for b in batches:
            for k, given, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = sentence_lines(text)
                keys.append(k)
                labels.append(given)
                held.append(given is not None and zlib.crc32(str(k).encode()) % 2 == 1)
                n_lines.append(len(own))
                lines += own
                size += sum(map(len, own))
                if size >= CHUNK_CHARS:
                    yield row(coded(keys, labels, held, n_lines, lines))
                    keys, labels, held, n_lines, lines, size = [], [], [], [], [], 0
        if keys:
            yield row(coded(keys, labels, held, n_lines, lines))

    return cut_lineage(docs.select("k", "labels", "text").mapInArrow(run, "chunk binary"))


def matches(a: ahocorasick.Automaton, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, term) of every match in a chunk, in order."""
    found = list(a.iter_long(c.text))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, term = np.array(found, np.int64).T
    ends = np.flatnonzero(np.frombuffer(c.text.encode("utf-32-le"), np.uint32) == 10)  # where lines end, in characters
    return np.searchsorted(ends, end), term


def sentence_subjects(c: Chunk, sentence: np.ndarray, subject: np.ndarray, weight: np.ndarray, number: dict[str, int]) -> np.ndarray:
    """Of each sentence: the only subject of its terms; without terms, the only label of its document, or the subject that most of it has; else -1."""
    n, of, docs = len(c.n_words), len(number), len(c.keys)
    score = np.bincount(sentence * of + subject, weight, n * of).reshape(n, of) if of else np.zeros((n, 1))
    best = score.max(1)
    strong = (score > 0) & (score >= BESIDE * best[:, None])
    single = np.where(strong.sum(1) == 1, strong.argmax(1), -1)
    doc = np.repeat(np.arange(docs), c.n_lines)
    named = np.bincount(doc[single >= 0] * max(1, of) + single[single >= 0], minlength=docs * max(1, of)).reshape(docs, max(1, of))
    only = np.array([number.get(x[0], -1) if x and len(x) == 1 and not h else -1 for x, h in zip(c.labels, c.held)], np.int64)
    only = np.where((only >= 0) & (named[np.arange(docs), only] > 0), only, -1)  # labels can be wrong; one counts where some sentence agrees
    lone = ((named > 0).sum(1) == 1) & (named.sum(1) >= np.maximum(2, 0.4 * c.n_lines))
    plain = np.where(only >= 0, only, np.where(lone, named.argmax(1), -1))
    return np.where(single >= 0, single, np.where(best == 0, plain[doc], -1))


def term_counts(c: Chunk, subject: np.ndarray, n_subjects: int) -> pa.RecordBatch:
    """term, subject, n: how often each word of three letters or more and each two words in a row occur in a chunk, by the sentences' subjects."""
    v, w, width = len(c.vocabulary), c.words.astype(np.int64), n_subjects + 1
    sentence = np.repeat(np.arange(len(c.n_words)), c.n_words)
    of = subject[sentence] + 1
    long = np.array([len(x) > 2 for x in c.vocabulary], bool)
    single = np.bincount(w * width + of, minlength=v * width).reshape(v, width)
    single[~long] = 0
    i, s = np.nonzero(single)
    names, of_term, n = [c.vocabulary[x] for x in i.tolist()], s, single[i, s]
    at = np.flatnonzero(sentence[1:] == sentence[:-1])
    code = pa.array(w[at] * v + w[at + 1]).dictionary_encode()
    pairs = code.dictionary.to_numpy()
    table = np.bincount(code.indices.to_numpy().astype(np.int64) * width + of[at], minlength=len(pairs) * width).reshape(-1, width)
    i, s = np.nonzero(table)
    names += [f"{c.vocabulary[x // v]} {c.vocabulary[x % v]}" for x in pairs[i].tolist()]
    of_term, n = np.concatenate([of_term, s]), np.concatenate([n, table[i, s]])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(of_term - 1, pa.int32()), pa.array(n, pa.int64())], names=["term", "subject", "n"])


@dataclass
class Counts:
    """Terms that occur mostly with one subject (term, subject, times with it, times in all), the common words that occur with any, and how many terms
    there were beyond ``MAX_TERMS``."""

    good: list[tuple[str, int, int, int]]
    common: set[str]
    dropped: int


def count_terms(chunks: DataFrame, lexicon: Lexicon) -> Counts:
    """Counts over all documents."""
    shared = chunks.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        a, (owner, weight) = lex.automaton(), lex.arrays()
        number = {s: i for i, s in enumerate(lex.subjects)}
        for c in unpacked(batches):
            sentence, term = matches(a, c)
            yield term_counts(c, sentence_subjects(c, sentence, owner[term], weight[term], number), len(number))

    counted = chunks.mapInArrow(run, "term string, subject int, n long").groupBy("term", "subject").agg(F.sum("n").alias("n"))
    has = F.col("subject") >= 0
    total = counted.groupBy("term").agg(F.sum("n").alias("seen"), F.sum(F.when(has, F.col("n"))).alias("all"), F.max(F.when(has, F.struct("n", "subject"))).alias("top"))
    good = (F.col("top.n") >= LEAST_SUPPORT) & (F.col("top.n") >= LEAST_PURITY * F.col("all")) & (F.col("all") >= LEAST_ASSIGNED * F.col("seen"))
    common = ~F.col("term").contains(" ") & (F.col("all") >= 10 * LEAST_SUPPORT) & (F.coalesce(F.col("top.n"), F.lit(0)) < 0.5 * F.col("all"))
    kept = cut_lineage(total.select("term", "all", "top", F.coalesce(good, F.lit(False)).alias("good"), F.coalesce(common, F.lit(False)).alias("common")).where("good OR common"))  # read thrice below
    n = kept.where("good").count()
    terms_ = kept.where("good").orderBy(F.desc("top.n"), "term").limit(MAX_TERMS).collect()
    words = kept.where("common").orderBy(F.desc("all"), "term").limit(MAX_TERMS).select("term").collect()
    return Counts([(r.term, r.top.subject, r.top.n, r["all"]) for r in terms_], {r.term for r in words}, max(0, n - MAX_TERMS))


def grown(lexicon: Lexicon, counts: Counts) -> Lexicon:
    """The curated terms that hold, and the learnt ones. Weight: how sure the term is of its subject (a lower bound of its purity)."""
    weights: dict[str, tuple[int, float]] = {}
    for term, s, n, total in counts.good:
        words = term.split(" ")
        if len(words) > 1 and any(w in counts.common or len(w) < 3 for w in (words[0], words[-1])):
            continue
        p = n / total
        low = (p + 1 / (2 * total) - math.sqrt((p * (1 - p) + 1 / (4 * total)) / total)) / (1 + 1 / total)
        if low >= LEAST_PURITY - 0.1:
            weights[term] = (s, min(1.0, low))
    # of phrases and their words, what carries the meaning: the phrases if a word hardly occurs without them, else the word
    n_of = {t: n for t, _, n, _ in counts.good}
    phrases = [t for t in weights if " " in t]
    inside: Counter[str] = Counter()
    for t in phrases:
        for x in set(t.split(" ")):
            inside[x] += n_of[t]
    for x in [x for x in weights if inside.get(x, 0) >= WITHIN * n_of[x]]:
        del weights[x]
    for t in phrases:
        if any(x in weights and weights[x][0] == weights[t][0] for x in t.split(" ")):
            del weights[t]
    for t, (s, w) in lexicon.weights.items():
        if t not in weights:
            weights[t] = (s, w)
    return Lexicon(lexicon.subjects, weights)


@dataclass
class Hits:
    """Of the documents of a chunk: keys, labels and whether held out, numbers of sentences; of each sentence with terms its document, its
    number of words and of its terms; and the terms."""

    keys: list
    labels: list[list[str] | None]
    held: list[bool]
    n_lines: np.ndarray
    doc: np.ndarray
    n_words: np.ndarray
    n_terms: np.ndarray
    terms: np.ndarray


def term_hits(chunks: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The lexicon's terms in all documents, written to the shared folder."""
    shared = chunks.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value.automaton()
        for c in unpacked(batches):
            sentence, term = matches(a, c)
            at, n = np.unique(sentence, return_counts=True)
            doc = np.repeat(np.arange(len(c.keys)), c.n_lines)
            yield row(Hits(c.keys, c.labels, c.held, c.n_lines, doc[at].astype(np.int32), c.n_words[at], n.astype(np.int32), term.astype(np.int32)))

    return cut_lineage(chunks.mapInArrow(run, "chunk binary"))


def rarity(hits: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Of each term: how rare it is among all documents, 0.3 to 1."""
    n_terms = len(lexicon.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs = np.zeros(n_terms, np.int64), 0
        for h in unpacked(batches):
            df += np.bincount(np.unique(np.repeat(h.doc, h.n_terms).astype(np.int64) * n_terms + h.terms) % n_terms, minlength=n_terms)
            docs += len(h.keys)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], docs))], names=["i", "n"])

    rows = hits.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # at most a row a term
    df = np.zeros(n_terms + 1)
    for r in rows:
        df[r.i] = r.n
    n = max(2.0, df[-1])
    return np.maximum(0.3, np.log(n / (1 + df[:-1])) / math.log(n))


@dataclass
class Learnt:
    """What the operator learns: subjects, of each term its subject and its weight times rarity, and of each subject its thresholds, with what they
    achieve on the held-out labels (right, found, labelled)."""

    subjects: list[str]
    lexicon: Lexicon
    value: np.ndarray
    score: np.ndarray
    share: np.ndarray
    dropped: int = 0
    achieved: list[tuple[int, int, int]] = field(default_factory=list)


def shares(h: Hits, m: Learnt, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, subject) and share of sentences, of those that any sentence of a document treats by the given thresholds of sentences."""
    n, of = len(h.doc), max(1, len(m.subjects))
    owner, _ = m.lexicon.arrays()
    sentence = np.repeat(np.arange(n), h.n_terms)
    sums = np.bincount(sentence * of + owner[h.terms], m.value[h.terms], n * of).reshape(n, of)
    treated = (sums > 0) & (sums >= score[None, :] * np.sqrt(h.n_words)[:, None]) & (sums >= BESIDE * sums.max(1, keepdims=True, initial=0.0))
    at, s = np.nonzero(treated)
    counts = np.bincount(h.doc[at].astype(np.int64) * of + s, minlength=len(h.keys) * of)
    some = np.flatnonzero(counts)
    return np.stack([some // of, some % of], 1), counts[some] / h.n_lines[some // of]


def calibrate(hits: DataFrame, m: Learnt) -> None:
    """Sets each subject's thresholds to those that agree best with the held-out labels; the nominal ones on ties and where there are none."""
    of, cells = len(m.subjects), [(a, b) for a in SCORES for b in SHARES]
    shared = hits.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        number = {s: i for i, s in enumerate(m.subjects)}
        right, found, labelled = (np.zeros((len(cells), of), np.int64) for _ in range(3))
        for h in unpacked(batches):
            held = np.array(h.held, bool)
            truth = np.zeros((len(h.keys), of), bool)
            for d in np.flatnonzero(held):
                truth[d, [number[x] for x in h.labels[d]]] = True
            labelled += truth.sum(0)
            if not held.any():
                continue
            for i, a in enumerate(SCORES):
                at, share = shares(h, m, np.full(of, a))
                of_held = held[at[:, 0]]
                at, share = at[of_held], share[of_held]
                ok = truth[at[:, 0], at[:, 1]]
                for j, b in enumerate(SHARES):
                    over = share >= b
                    found[i * len(SHARES) + j] += np.bincount(at[over, 1], minlength=of)
                    right[i * len(SHARES) + j] += np.bincount(at[over & ok, 1], minlength=of)
        cell, s = np.divmod(np.arange(len(cells) * of), max(1, of))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, s, right.ravel(), found.ravel(), labelled.ravel())], names=["cell", "s", "r", "f", "l"])

    rows = hits.mapInArrow(run, "cell long, s long, r long, f long, l long").groupBy("cell", "s").agg(F.sum("r").alias("r"), F.sum("f").alias("f"), F.sum("l").alias("l")).collect()
    right, found, labelled = (np.zeros((len(cells), of)) for _ in range(3))
    for r in rows:
        right[r.cell, r.s], found[r.cell, r.s], labelled[r.cell, r.s] = r.r, r.f, r.l
    pool = POOLED / max(1.0, labelled[0].sum()) if len(cells) else 0.0
    f1 = lambda r, f, l: 2 * r / np.maximum(1e-9, f + l)
    for s in range(of):
        fit = f1(right[:, s] + pool * right.sum(1), found[:, s] + pool * found.sum(1), labelled[:, s] + pool * labelled.sum(1))
        best = max(range(len(cells)), key=lambda i: (round(float(fit[i]), 3), -abs(cells[i][0] - SCORE) - abs(cells[i][1] - SHARE)))
        if labelled[0].sum() == 0:
            best = cells.index((SCORE, SHARE))
        m.score[s], m.share[s] = cells[best]
        m.achieved.append((int(right[best, s]), int(found[best, s]), int(labelled[best, s])))


def learn(docs: DataFrame, key: str, text: str, labels: DataFrame, subjects: list[str]) -> tuple[Learnt, DataFrame]:
    """What is learnt, and all documents' hits. labels: key, subject (in any letter case; repeats and unknown subjects don't matter)."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("text"))
    given = labels.where(F.lower(F.trim("subject")).isin(*subjects)).groupBy(F.col(key).alias("k")).agg(F.sort_array(F.collect_set(F.lower(F.trim("subject")))).alias("labels"))
    chunks = read_documents(rows.join(given, "k", "left"))
    lexicon = start = curated(subjects)
    dropped = 0
    for _ in range(2):
        counts = count_terms(chunks, lexicon)
        lexicon, dropped = grown(start, counts), counts.dropped
    hits = term_hits(chunks, lexicon)
    n = len(subjects)
    m = Learnt(subjects, lexicon, lexicon.arrays()[1] * rarity(hits, lexicon), np.full(n, SCORE), np.full(n, SHARE), dropped)
    calibrate(hits, m)
    return m, hits


def codes(subjects: DataFrame) -> list[str]:
    """The subject codes of a table of them."""
    found = sorted({r[0].strip().lower() for r in subjects.select("subject").where("subject IS NOT NULL").distinct().limit(MAX_SUBJECTS + 1).collect()})
    if len(found) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    return found


def subjects_of(docs: DataFrame, key: str, text: str, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """key, subject, share: every subject of each document. subjects: the codes, one row each (a fixed, small table). Null, empty and blank texts
    and those without subject matter have no row; equal texts have equal subjects. Other columns are not read."""
    m, hits = learn(docs, key, text, labels, codes(subjects))
    shared = docs.sparkSession.sparkContext.broadcast(m)
    key_type = docs.schema[key].dataType.simpleString()
    arrow_type = docs.select(F.col(key).alias("k")).limit(0).toArrow().schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for h in unpacked(batches):
            at, share = shares(h, m, m.score)
            kept = share >= m.share[at[:, 1]] if len(at) else np.zeros(0, bool)
            at, share = at[kept], share[kept]
            yield pa.RecordBatch.from_arrays([pa.array([h.keys[i] for i in at[:, 0].tolist()], arrow_type), pa.array([m.subjects[i] for i in at[:, 1].tolist()], pa.string()), pa.array(share)], names=[key, "subject", "share"])

    return hits.mapInArrow(run, f"`{key}` {key_type}, subject string, share double")
