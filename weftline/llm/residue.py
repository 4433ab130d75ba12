"""Template residue and error-page text (problem 1): positive-unlabelled naive Bayes by expectation-maximisation.

Passages are the leaves that the page model places in a page's main region. Trusted positives are records whose main region shows unfilled
placeholders or filler throughout, is a short one of plain notices, or is data under error keys; everything else is unlabelled. Naive Bayes starts
with the unlabelled as negatives, then expectation and maximisation move the unlabelled passages to where they belong. Every record is then
scored: the clipped log-odds of its passages, weighted by their length, are added up, so that a real body outweighs a quoted notice. Nothing
but this score decides; that a page is short, that it is data or holds nothing but signs are tokens like any other.

All passages of all records are fitted on and scored. Pages are read once (``read_chunks``); the passages go on as numbers of tokens. The model has a
fixed size (``BUCKETS`` weights): words beyond the signs of shape share buckets by hash.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import notices
from weftline.llm.packed import row, unpacked
from weftline.llm.pages import EDGE
from weftline.llm.pages import FEATURE as F_
from weftline.llm.pages import Trees
from weftline.session import cut_lineage

BUCKETS = 1 << 18
EM_STEPS = 8
#: EM ends when the expected number of residue passages changes by less than this share.
SETTLED = 0.002
CLIP = 4.0
#: A record is trusted to be a notice if its main region has at most so many words, and passages.
TRUSTED_WORDS, TRUSTED_PASSAGES = 90, 6
#: Tokens of a chunk of passages.
CHUNK_TOKENS = 500_000

_SLOT = re.compile(
    r"\{\{[^{}]{1,60}\}\}|\$\{[^{}]{1,60}\}|#\{[^{}]{1,60}\}|<%=?[^<>]{1,60}%>|__[A-Z][A-Z0-9_]*?__|@@[A-Za-z_]{2,40}@@|\*\|[A-Z0-9_:]{2,40}\|\*|%%[A-Za-z_]{2,40}%%|%[A-Z][A-Z_]{2,40}%|\[\[[^\[\]]{1,60}\]\]"
    r"|\[(?:your|insert|enter|add|my) [^\[\]]{1,50}\]|\[[A-Z][A-Z _]{2,40}\]|(?<![\w{$#])\{[A-Za-z][A-Za-z0-9_.|]{1,40}\}(?!\})|\$[A-Za-z_]{3,40}\$|«[A-Z_ ]{3,40}»|<<[A-Za-z_ ]{2,40}>>|:[a-z]+_[a-z_]+:"
)
#: One of these is in every placeholder, or both of the next.
_SLOT_SIGNS = ("{", "[", "%", "__", "@@", "*|", "$", "«", "<<")
_SLOT_PAIR = (":", "_")
_FILLER = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim mollis varius purus justo vero porta fusce proin augue risus massa cursus quam vestibulum pellentesque habitant morbi tristique malesuada egestas curabitur donec vivamus aliquam nunc felis orci tellus".split())
#: Words of one row of keys, or without a vowel.
_MASH = re.compile(r"[asdfghjklöä]{3,}|[qwertyuiop]{5,}|[^\W\daeiouyáéíóúäöüàèùâêîôû_]{4,}")
_DOTS = re.compile(r"(?:^|>|\n)[ \t]*(?:([.\-*_=~#])\1{3,}[ \t]+)+([.\-*_=~#])\2{3,}[ \t]*(?:$|<|\n)")
_ERROR_KEYS = frozenset("error errors code message status detail details fault exception trace reason title type path timestamp request_id requestid ok success".split())
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")
_LETTER_RUN = re.compile(r"(.)\1{4,}")
_SIGN_RUNS = tuple(c * 5 for c in ".-_=*~#?!")

KINDS = list(notices.PHRASES)
SIZES = 12
#: The signs of shape; they have numbers of their own.
SIGNS = (
    ["<slot>", "<slots>", "<slot+>", "<repeats>", "<filler>", "<mash>", "<nothing>", "<run>", "<dots>", "<json>", "<plain keys>", "<error keys>", "<own keys>"]
    + [f"<words {i}>" for i in range(SIZES)] + [f"<page {i}>" for i in range(SIZES)]
    + [f"<notice {i}>" for i in range(1, 4)] + [f"<{k}>" for k in KINDS] + [f"<key {k}>" for k in sorted(_ERROR_KEYS)]
)
NUMBER = {s: i for i, s in enumerate(SIGNS)}
_FIRST_WORD = 256


def number(token: str) -> int:
    """The bucket of a token."""
    n = NUMBER.get(token)
    return n if n is not None else _FIRST_WORD + zlib.crc32(token.encode()) % (BUCKETS - _FIRST_WORD)


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k, kind in enumerate(KINDS):
        for p in notices.phrases(kind):
            a.add_word(p, (len(p), k))
    a.make_automaton()
    return a


_FIND = _automaton()


def notice_signs(low: str) -> tuple[int, set[str]]:
    """How much of a passage (in lower case) phrases of notices cover, from 0 (none) to 3 (a third or more), and their kinds."""
    covered, kinds, last = 0, set(), -1
    n = len(low)
    for end, (size, k) in _FIND.iter(low):
        begin = end - size + 1
        if (begin and low[begin - 1].isalnum()) or (end + 1 < n and low[end + 1].isalpha() and low[end].isalnum()):
            continue
        covered += end - max(last, begin - 1)
        last = max(last, end)
        kinds.add(f"<{KINDS[k]}>")
    return (0 if not kinds else 3 if covered >= 0.33 * n else 2 if covered >= 0.12 * n else 1), kinds


#: Signs of a word, above its bucket: filler, mashed from keys, with a letter five times in a row.
_IS_FILLER, _IS_MASH, _IS_RUN = 1 << 24, 1 << 25, 1 << 26


class _Tokens(dict):
    """A text without white space, in lower case -> the bucket and signs of its only word; or minus the number of its entry in ``several``."""

    several: list[tuple[int, ...]] = [()]

    def __missing__(self, text: str) -> int:
        codes = tuple(word_code(w) for w in _WORDS.findall(text))
        if len(codes) == 1:
            code = codes[0]
        else:  # no word at all is entry 0
            code = -len(self.several) if codes else 0
            if codes:
                self.several.append(codes)
        self[text] = code
        return code


_tokens_of = _Tokens()


def word_code(w: str) -> int:
    """The bucket of a word, and its signs."""
    as_number = w[0] <= "9" and not (len(w) == 3 and w[0] in "45")
    return number("#" if as_number else w) | (w in _FILLER) * _IS_FILLER | (_MASH.fullmatch(w) is not None) * _IS_MASH | (len(w) > 4 and _LETTER_RUN.search(w) is not None) * _IS_RUN


def grade(n: int) -> int:
    """The size class of a number of words."""
    return min(SIZES - 1, n.bit_length())


_OF_WORDS = [NUMBER[f"<words {i}>"] for i in range(SIZES)]
_SLOTS = {True: (NUMBER["<slot>"], NUMBER["<slots>"]), False: (NUMBER["<slot>"], NUMBER["<slot+>"])}


def token_numbers(passage: str) -> tuple[list[int], int]:
    """The buckets of a passage's tokens (its words, and signs of its shape), and its number of words."""
    filled, slots = _SLOT.subn(" ", passage) if any([c in passage for c in _SLOT_SIGNS]) or all([c in passage for c in _SLOT_PAIR]) else (passage, 0)
    low = filled.lower()
    if len(_tokens_of) > 200_000:
        _tokens_of.clear()
        del _tokens_of.several[1:]
    codes = list(map(_tokens_of.__getitem__, low.split()))
    n, out = len(codes), set(codes)
    if min(out, default=1) <= 0:
        several = [_tokens_of.several[-x] for x in codes if x <= 0]
        n += sum(map(len, several)) - len(several)
        out = {x for x in out if x > 0}.union(*several)
    distinct = len(out)
    signed = [x for x in out if x >= BUCKETS]
    out = {x & (BUCKETS - 1) for x in out} if signed else out
    if slots:
        out.update(_SLOTS[slots > 1 or n <= 2])
    if n >= 4:
        if distinct <= 0.34 * n:
            out.add(NUMBER["<repeats>"])
        if signed and sum([x & _IS_FILLER > 0 for x in signed]) >= 0.5 * distinct:
            out.add(NUMBER["<filler>"])
    if n >= 2 and signed and sum([x & _IS_MASH > 0 for x in signed]) >= 0.7 * distinct:
        out.add(NUMBER["<mash>"])
    if not n and not slots:
        out.add(NUMBER["<nothing>"])
    if signed and any([x & _IS_RUN for x in signed]) or any([x in passage for x in _SIGN_RUNS]):
        out.add(NUMBER["<run>"])
    out.add(_OF_WORDS[grade(n)])
    cover, kinds = notice_signs(low)
    if cover:
        out.add(NUMBER[f"<notice {cover}>"])
        out.update([NUMBER[k] for k in kinds])
    return list(out), n


_passage_memo: dict[str, tuple[list[int], int]] = {}


def _tokens(passage: str) -> tuple[list[int], int]:
    if len(passage) > 200:  # long ones seldom recur
        return token_numbers(passage)
    known = _passage_memo.get(passage)
    if known is None:
        known = token_numbers(passage)
        if len(_passage_memo) > 50_000:
            _passage_memo.clear()
        _passage_memo[passage] = known
    return known


def json_tokens(text: str) -> tuple[list[int], bool] | None:
    """Tokens of a JSON body, and whether all its keys are those of errors and say so; None if it is no JSON."""
    pairs: list[tuple[str, object]] = []
    try:
        json.loads(text, object_pairs_hook=lambda p: pairs.extend(p) or dict(p))
    except (ValueError, RecursionError):
        return None
    keys = [k.lower() for k, _ in pairs]
    errors = [k for k in keys if k in _ERROR_KEYS]
    out = {"<json>", *(f"<key {k}>" for k in errors)}
    if len(errors) < len(keys):
        out.add("<plain keys>" if errors else "<own keys>")
    told = bool(keys) and len(errors) == len(keys) and any(k in ("error", "errors", "fault", "exception") or "fail" in str(v).lower() for k, v in pairs)
    if told:
        out.add("<error keys>")
    told_of = [k for k in keys if k not in _ERROR_KEYS] + [v.lower() for _, v in pairs if isinstance(v, str)]
    words = {word_code(w) & (BUCKETS - 1) for x in told_of for w in _WORDS.findall(x)}
    return sorted({NUMBER[x] for x in out} | words), told


_PLAIN_FURNITURE = frozenset(F_["is_" + k] for k in ("legal", "consent", "share", "byline", "letter", "comments", "related", "path", "notice", "menu"))
_GOVERNED = EDGE["governed"]


def passages(t: Trees, p: np.ndarray, n: int) -> list[list[tuple[str, bool]]]:
    """Of each page: the passages of its main region, and whether each is a heading. Where nothing is in the main region, what is not plainly
    furniture stands for it, else notices about scripts."""
    main: list[list[tuple[str, bool]]] = [[] for _ in range(n)]
    heading, page = F_["heading"], t.page
    for node, text in t.text.items():
        if p[node] > 0.5:
            main[page[node]].append((text, heading in t.features[node]))
    if all(main):
        return main
    doubtful: list[list[tuple[str, bool]]] = [[] for _ in range(n)]
    scripted: list[list[tuple[str, bool]]] = [[] for _ in range(n)]
    scripts, link = F_["has_scripts"], F_["all_link"]
    for node, text in t.text.items():
        if main[page[node]]:
            continue
        f = t.features[node]
        if scripts in f:
            scripted[page[node]].append((text, False))
        elif _SLOT.search(text) or notice_signs(text.lower())[0] >= 2 or t.edge[node] != _GOVERNED and link not in f and not _PLAIN_FURNITURE.intersection(f):
            doubtful[page[node]].append((text, False))
    return [a or b or c for a, b, c in zip(main, doubtful, scripted)]


_SURE = frozenset((NUMBER["<filler>"], NUMBER["<repeats>"], NUMBER["<slot>"], NUMBER["<dots>"]))
_NOTICE = frozenset((NUMBER["<notice 2>"], NUMBER["<notice 3>"]))


def trusted(found: list[tuple[list[int], int]]) -> bool:
    """Whether a record is residue for certain: filler or placeholders throughout, or a short main region of plain notices. found: tokens and words of
    its passages."""
    formless = [not _SURE.isdisjoint(x) for x, _ in found]
    if not found:
        return False
    if sum(formless) >= 0.7 * len(found):
        return True
    plain = sum(a or not _NOTICE.isdisjoint(x) for a, (x, _) in zip(formless, found))
    return plain >= 0.5 * len(found) and len(found) <= TRUSTED_PASSAGES and sum(n for _, n in found) <= TRUSTED_WORDS


@dataclass
class Residue:
    """The log-odds of residue: before anything is known of a passage, and what each bucket of tokens adds."""

    prior: float = -CLIP
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))

    def to_bytes(self) -> bytes:
        return np.float64(self.prior).tobytes() + self.weights.astype(np.float64).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Residue:
        x = np.frombuffer(data, np.float64)
        return cls(float(x[0]), x[1:].copy())


@dataclass
class Chunk:
    """Passages of some records as flat arrays: of each record its key, of each passage its record, whether that is trusted, its weight in the
    record's score (0: a heading, told only where there is nothing else) and its tokens; and what else was asked for of each record."""

    keys: list[tuple[str | None, int | None]] = field(default_factory=list)
    record: array = field(default_factory=lambda: array("i"))
    sure: array = field(default_factory=lambda: array("b"))
    weight: array = field(default_factory=lambda: array("f"))
    sizes: array = field(default_factory=lambda: array("i"))
    tokens: array = field(default_factory=lambda: array("i"))
    line_of: list[np.ndarray] = field(default_factory=list)
    lines: list[np.ndarray] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def add(self, found: list[tuple[list[int], int]], headings: list[bool], sure: bool) -> None:
        alone = all(headings)
        r = len(self.keys)
        for (toks, n), heading in zip(found, headings):
            self.record.append(r)
            self.sure.append(sure)
            self.weight.append(1 + math.log2(1 + n) if alone or not heading else 0.0)
            self.sizes.append(len(toks))
            self.tokens.extend(toks)

    def data(self) -> tuple:
        i = lambda x: np.frombuffer(x, np.int32)
        joined = lambda x: np.concatenate(x).astype(np.int32) if x else np.zeros(0, np.int32)
        return self.keys, i(self.record), np.frombuffer(self.sure, bool), np.frombuffer(self.weight, np.float32), i(self.sizes), i(self.tokens), joined(self.line_of), joined(self.lines), self.texts


def read_chunks(pages: DataFrame, lines: bool = False, texts: bool = False) -> DataFrame:
    """Chunks of all pages (tbl, rec_id, text), read once and written to the shared folder; with the lines of their main bodies, or the bodies' texts.
    Null, empty and blank texts have no passages and no lines, and empty texts."""
    from weftline.llm.body import blocks, body_of, lines_of, read_pages
    from weftline.llm.page_model import trained

    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk()
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            own = b.column(2).to_pylist()
            for begin, end in blocks(own):
                t, p = read_pages(shared.value, own[begin:end])
                first = len(chunk.keys)
                for i, ps in enumerate(passages(t, p, end - begin)):
                    if i in t.data and (told := json_tokens(own[begin + i])) is not None:
                        chunk.add([(told[0], len(told[0]))], [False], told[1])
                    elif ps:
                        found = [_tokens(x) for x, _ in ps]
                        size = NUMBER[f"<page {grade(sum(n for _, n in found))}>"]
                        chunk.add([([*x, size], n) for x, n in found], [h for _, h in ps], trusted(found))
                    elif own[begin + i] and _DOTS.search(own[begin + i]):  # nothing but furniture and lines of filler signs
                        chunk.add([([NUMBER["<dots>"], NUMBER["<nothing>"], NUMBER["<page 0>"]], 0)], [False], True)
                    chunk.keys.append(keys[begin + i])
                if lines:
                    of, no = lines_of(t, p)
                    chunk.line_of.append(of + first)
                    chunk.lines.append(no)
                if texts:
                    chunk.texts += body_of(t, p, end - begin)
                if len(chunk.tokens) >= CHUNK_TOKENS:
                    yield row(chunk.data())
                    chunk = Chunk()
        if chunk.keys:
            yield row(chunk.data())

    return cut_lineage(pages.select("tbl", F.col("rec_id").cast("long").alias("rec_id"), "text").mapInArrow(run, "chunk binary"))


def _odds(model: Residue, record: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """The log-odds of each passage."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return model.prior + np.bincount(of, model.weights[tokens], len(sizes))


def _expected(chunks: DataFrame, model: Residue | None) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Of each bucket, the expected residue passages and all passages that hold it; and both over all passages. Without a model only what is trusted is residue."""
    shared = chunks.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        pos, seen = np.zeros(BUCKETS), np.zeros(BUCKETS)
        total = [0.0, 0.0]
        for _, record, sure, _, sizes, tokens, *_ in unpacked(batches):
            q = sure.astype(float)
            if model is not None:
                q = np.where(sure, 1.0, 1 / (1 + np.exp(-np.clip(_odds(model, record, sizes, tokens), -30, 30))))
            pos += np.bincount(tokens, np.repeat(q, sizes), BUCKETS)
            seen += np.bincount(tokens, minlength=BUCKETS)
            total[0] += q.sum()
            total[1] += len(q)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(pos[at], total[0])), pa.array(np.append(seen[at], total[1]))], names=["bucket", "pos", "n"])

    width = chunks.sparkSession.sparkContext.defaultParallelism
    counted = chunks.coalesce(4 * width).mapInArrow(run, "bucket int, pos double, n double").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    rows = counted.toArrow()  # at most BUCKETS + 1 rows
    bucket, p, n = (rows.column(i).to_numpy() for i in range(3))
    pos, seen = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    pos[bucket], seen[bucket] = p, n
    return pos[:-1], seen[:-1], float(pos[-1]), float(seen[-1])


def learn(chunks: DataFrame) -> Residue:
    """Naive Bayes (presence of tokens) of trusted and unlabelled passages, by expectation-maximisation over all chunks. Where no record is trusted, or all
    are, nothing can be learnt and no record is residue."""
    model, before = None, 0.0
    for _ in range(EM_STEPS):
        pos, n, a, total = _expected(chunks, model)
        b = total - a
        if a <= 0 or b <= 0:
            return Residue()
        weights = np.log((pos + 0.3) / (a + 0.6)) - np.log((n - pos + 0.3) / (b + 0.6))
        model = Residue(math.log(a / b), np.where(n >= 2, weights, 0.0))
        if abs(a - before) <= SETTLED * a:
            break
        before = a
    return model


def chunk_scores(model: Residue, data: tuple) -> tuple[list, np.ndarray]:
    """The keys of a chunk's records, and their scores; nan: a record without passages."""
    keys, record, _, weight, sizes, tokens = data[:6]
    score = np.bincount(record, np.clip(_odds(model, record, sizes, tokens), -CLIP, CLIP) * weight, len(keys)) if len(sizes) else np.zeros(len(keys))
    held = np.bincount(record, minlength=len(keys)) > 0 if len(record) else np.zeros(len(keys), bool)
    return keys, np.where(held, score, np.nan)


def residue_scores(pages: DataFrame, model: Residue | None = None) -> DataFrame:
    """tbl, rec_id, score of every row (tbl, rec_id, text) with a text that isn't blank; above 0: residue in place of content. Equal rows have equal
    scores. Rows with null, empty or blank text have no row. Other columns are not read."""
    chunks = read_chunks(pages.where(F.col("text").rlike(r"\S")))
    shared = pages.sparkSession.sparkContext.broadcast(model or learn(chunks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in unpacked(batches):
            keys, score = chunk_scores(shared.value, data)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int64()), pa.array(np.nan_to_num(score, nan=-1.0))], names=["tbl", "rec_id", "score"])

    return chunks.mapInArrow(run, "tbl string, rec_id long, score double")


def save(model: Residue, spark: SparkSession, folder: str) -> None:
    """Writes a learnt model, for later runs over other pages."""
    spark.createDataFrame([(bytearray(model.to_bytes()),)], "model binary").write.mode("overwrite").parquet(folder)


def load(spark: SparkSession, folder: str) -> Residue:
    return Residue.from_bytes(bytes(spark.read.parquet(folder).first().model))
