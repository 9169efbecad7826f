"""Language identification of mixed texts: scripts, per-word scores, Viterbi over words.

The script of a word narrows the languages it can be in; each of them scores the word by the
log-probability of its letter trigrams; the best path through the words of a text, with a
penalty for each switch, labels spans of one language. Trigram counts are a Spark aggregate over
a bounded sample of labelled rows; texts are labelled in tasks, many texts at each step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ananas.llm.shared import slices

#: Labelled texts a language learns from, at most (on average; picked by a hash of the text).
SAMPLE_ROWS = 4000
#: Cost of a switch between words, in nats.
SWITCH = 12.0
#: Cells that letter trigrams are hashed to.
CELLS = 1 << 18
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.02
#: What a word costs in a language that doesn't use its script.
WRONG_SCRIPT = -60.0
#: Letters whose words are scored at a time, and letters whose texts advance together.
PIECE, CHUNK = 250_000, 2_000_000

# Scripts by range of code points (first, last, script).
SCRIPTS = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
]
NAMES = sorted({s for _, _, s in SCRIPTS})

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, script) by code point, built once a worker; script 0 is any other."""
    if not _TABLES:
        top = 0x110000
        _TABLES["letter"] = np.fromiter((chr(c).isalpha() for c in range(top)), dtype=bool, count=top)
        script = np.zeros(top, dtype=np.int8)
        for a, b, s in SCRIPTS:
            script[a : b + 1] = NAMES.index(s) + 1
        _TABLES["script"] = script
    return _TABLES["letter"], _TABLES["script"]


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # (CELLS, languages)
    allowed: np.ndarray  # (scripts + 1, languages)


def _words(texts: list[str]):
    """Of the joined texts: trigram cell by letter, first letter of each word, text of each word, script."""
    is_letter, script = _tables()
    points = np.frombuffer("\0".join(t.lower() for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = is_letter[points]
    inside = np.flatnonzero(letter)
    if not len(inside):
        return None
    new = np.r_[True, np.diff(inside) > 1]
    starts = np.flatnonzero(new)
    around = np.r_[np.uint32(0), np.where(letter, points, 0), np.uint32(0)].astype(np.uint64)
    a, b, c = around[inside], around[inside + 1], around[inside + 2]
    cell = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F) + c * np.uint64(0x165667B19E3779F9)
    cell = ((cell ^ (cell >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(46)
    ends = np.flatnonzero(points == 0)  # a text's own NUL would only split it: they are blanked before
    return cell.astype(np.int64), starts, np.searchsorted(ends, inside[starts]), script[points[inside]]


def _clean(texts) -> list[str]:
    return [(t or "").replace("\0", " ") for t in texts]


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def train(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from ``rows`` (text, lang), by hash at most about ``sample_rows`` a language."""
    rows = rows.filter("lang is not null and text is not null").select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((CELLS, 0), dtype=np.float32), np.zeros((len(NAMES) + 1, 0), dtype=bool))
    kept = F.lit(False)
    for lang, n in sizes.items():
        kept = F.when(F.col("lang") == lang, F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(min(1.0, sample_rows / n) * (1 << 20)) + 1).otherwise(kept)

    def count(batches):
        cells = np.zeros((len(languages), CELLS), dtype=np.int64)
        scripts = np.zeros((len(languages), len(NAMES) + 1), dtype=np.int64)
        at = {v: i for i, v in enumerate(languages)}
        for batch in slices(batches, 1):
            langs, texts = batch.column(0).to_pylist(), _clean(batch.column(1).to_pylist())
            for part, chunk in _chunks(texts, PIECE):
                if got := _words(chunk):
                    cell, starts, text, script = got
                    owner = np.array([at[v] for v in langs[part : part + len(chunk)]])
                    lang = owner[np.repeat(text, np.diff(np.r_[starts, len(cell)]))]
                    np.add.at(scripts, (lang, script), 1)
                    for i in np.unique(lang):
                        cells[i] += np.bincount(cell[lang == i], minlength=CELLS)
        for i, lang in enumerate(languages):
            for kind, n in (("cell", cells[i]), ("script", scripts[i])):
                full = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(full)), pa.array([kind] * len(full)), pa.array(full), pa.array(n[full])], names=["lang", "kind", "at", "n"])

    counted = rows.filter(kept).mapInArrow(count, "lang string, kind string, at long, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))
    logp = np.full((CELLS, len(languages)), 0.05)
    scripts = np.zeros((len(NAMES) + 1, len(languages)))
    for r in counted.collect():  # at most (cells + scripts) x languages
        (logp if r["kind"] == "cell" else scripts)[r["at"], languages.index(r["lang"])] += r["n"]
    logp = np.log(logp / logp.sum(axis=0)).astype(np.float32)
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True  # a script that no language has narrows nothing
    return Model(languages, logp, allowed)


def _chunks(texts: list[str], most: int):
    """Runs of texts of about ``most`` letters, with the place of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def viterbi(scores: np.ndarray, begin: np.ndarray, size: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Best language of each word; text i has rows ``begin[i]`` to ``begin[i] + size[i]`` of ``scores``.

    Texts advance together, longest first, one word at a step. Ties go to the first language.
    """
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
    back = np.zeros(scores.shape, dtype=np.int8 if scores.shape[1] < 128 else np.int16)
    own = np.arange(scores.shape[1])
    last = np.zeros((len(size), scores.shape[1]))
    for t, k in enumerate(alive):
        row = begin[:k] + t
        if t:
            was = last[:k]
            top = was.argmax(axis=1)
            jump = was[np.arange(k), top] - switch
            stay = was >= jump[:, None]
            back[row] = np.where(stay, own, top[:, None])
            last[:k] = np.where(stay, was, jump[:, None]) + scores[row]
        else:
            last[:k] = scores[row]
    best = np.zeros(len(scores), dtype=np.int64)
    state = last.argmax(axis=1)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        row = begin[:k] + t
        best[row] = state[:k]
        state[:k] = back[row, state[:k]]
    return best


def _scored(first: int, texts: list[str], model: Model):
    """(text, letters, scores by language) of each word; ``first`` is the place of the first text."""
    got = _words(texts)
    if not got:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, len(model.languages)))
    cell, starts, text, script = got
    scores = np.add.reduceat(model.logp[cell], starts, axis=0).astype(np.float64)
    scores[~model.allowed[script[starts]]] += WRONG_SCRIPT
    return text + first, np.diff(np.r_[starts, len(cell)]), scores


def label_texts(texts: list[str], model: Model, switch: float = SWITCH):
    """Per text: language or ``und``, score, spans ``language:first word:last word``."""
    out = [("und", 0.0, "")] * len(texts)
    for first, chunk in _chunks(texts, CHUNK) if model.languages else ():
        got = [_scored(part, piece, model) for part, piece in _chunks(chunk, PIECE)]
        text, letters, scores = (np.concatenate(c) for c in zip(*got))
        if not len(text):
            continue
        begin = np.flatnonzero(np.r_[True, np.diff(text) > 0])
        size = np.diff(np.r_[begin, len(text)])
        best = viterbi(scores, begin, size, switch)
        weight = np.zeros((len(begin), len(model.languages)))
        np.add.at(weight, (np.repeat(np.arange(len(begin)), size), best), letters)
        top = weight.argmax(axis=1)
        share = weight[np.arange(len(begin)), top] / weight.sum(axis=1)
        turn = np.r_[True, (np.diff(best) != 0) | (np.diff(text) > 0)]
        run = np.flatnonzero(turn)
        stop = np.r_[run[1:], len(best)]
        spans: dict[int, list[str]] = {}
        own = np.searchsorted(begin, run, side="right") - 1
        for r, e, i in zip(run, stop, own):
            spans.setdefault(i, []).append(f"{model.languages[best[r]]}:{r - begin[i]}:{e - begin[i] - 1}")
        for i, b in enumerate(begin):
            out[first + text[b]] = (model.languages[top[i]], float(share[i]), ",".join(spans[i]))
    return out


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): lang_pred, score, spans.

    The language is the one that labels most letters, the score its share of them. A text that is
    null or has no letter is ``und`` with score 0, as is every text if nothing was learned. A letter
    is what Unicode calls one; words are runs of letters. Rows are judged one by one; other columns
    are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # fixed by CELLS x languages

    def run(batches):
        for batch in slices(batches, 1):
            got = label_texts(_clean(batch.column(1).to_pylist()), Model(**shared.value), switch)
            cols = list(zip(*got)) if got else [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.string())], names=["doc_id", "lang_pred", "score", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, spans string")


def reject_unknown(docs: DataFrame, model: Model, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a known language."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    at = docs.columns.index(text)

    def run(batches):
        for batch in slices(batches, at):
            got = label_texts(_clean(batch.column(at).to_pylist()), Model(**shared.value), switch)
            yield batch.filter(pa.array([lang != "und" for lang, _, _ in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def learn_and_identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``identify`` with a model of the rows that aren't held out; ``held_out`` is returned, too."""
    model = train(docs.filter(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))).select("text", "lang"), sample_rows)
    out = identify(docs, model)
    return out.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
