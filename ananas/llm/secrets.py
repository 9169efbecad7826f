"""Secret scan: fixed patterns, and Markov models of random strings against ordinary identifiers.

Two first-order character models are trained from labelled strings; a token is added to the
pattern spans when its log-likelihood ratio is high enough in total and per character. Counting
is a Spark aggregate, the model a table bounded by the alphabet, and texts are scanned in tasks.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ananas.llm.shared import slices

#: Documents whose words serve as ordinary strings, at most (on average; picked by a hash of id and text).
SAMPLE_DOCS = 4000
#: Identifiers made of the words of a sampled document.
IDENTIFIERS = 20
#: Evidence for a random string, in nats: in total, and per character.
LEAST_TOTAL, LEAST_MEAN = 12.0, 0.7
#: Weight of single characters in the model of pairs.
PRIOR = 8.0
#: Shortest token that the models judge.
LEAST_LENGTH = 16

# The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "markov")
_WORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = re.compile(f"({'|'.join(map(_either_case, _WORDS))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
_CODE = np.full(128, len(ALPHABET), dtype=np.int64)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _i


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order; leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    # a run of hex digits is maximal either way, so the short ones needn't be matched first
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def labelled_strings(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(s, random): ordinary and random strings of about one length, from sampled documents.

    Ordinary are their tokens too short to be judged, and what people make of words: identifiers of
    three of them in the usual spellings (constants too), numbers, ids with dashes and rows of one sign.
    Random by construction are digests of the documents: hex, base 64, base 36 in capitals.
    """
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    words = d.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), 0)).alias("s")).filter(F.length("s") < LEAST_LENGTH).select("s", F.lit(False).alias("random"))
    sha = F.sha2(F.concat_ws("|", "doc_id", "text"), 256)
    kinds = F.array(sha, F.base64(F.unhex(sha)), *[F.conv(F.substring(sha, i, 15), 16, 36) for i in (1, 16, 31, 46)])
    made = d.select(F.explode(kinds).alias("s")).select("s", F.lit(True).alias("random"))
    three = d.select("doc_id", "text", F.slice(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,}"), 0), 1, 3 * IDENTIFIERS).alias("w"))
    three = three.select(F.explode(F.sequence(F.lit(0), F.lit(IDENTIFIERS - 1))).alias("k"), "w").select(F.lower(F.array_join(F.slice("w", 3 * F.col("k") + 1, 3), " ")).alias("w"), "k").filter("w <> ''")
    snake, camel = F.replace("w", F.lit(" "), F.lit("_")), F.replace(F.initcap("w"), F.lit(" "), F.lit(""))
    spelling = F.element_at(F.array(snake, camel, F.upper(snake), F.replace("w", F.lit(" "), F.lit("-")), F.replace("w", F.lit(" "), F.lit("/"))), F.pmod("k", F.lit(5)) + 1)
    part = lambda at, n: F.substring(sha, at, n)
    others = F.array(
        F.conv(part(1, 15), 16, 10), F.concat(F.lit("20"), F.conv(part(20, 12), 16, 10)), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
        F.repeat(F.element_at(F.array(*[F.lit(c) for c in "=-_/+"]), F.pmod(F.xxhash64("text"), F.lit(5)).cast("int") + 1), F.lit(20)),
    )
    plain = three.select(spelling.alias("s")).union(d.select(F.explode(others).alias("s")))
    return words.union(plain.select("s", F.lit(False).alias("random"))).union(made)


def train(strings: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each pair of neighbours, random over ordinary.

    What follows a character is smoothed by what characters occur at all, as by PRIOR more pairs.
    """
    size = len(ALPHABET)
    pairs = strings.filter("length(s) > 1").select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("s") - 1), lambda i: F.substr(F.col("s"), i, F.lit(2)))).alias("pair"))
    rows = pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()  # at most 2 x alphabet^2
    counts = np.zeros((2, size, size))
    for r in rows:
        a, b = ALPHABET.find(r["pair"][0]), ALPHABET.find(r["pair"][1])
        if a >= 0 and b >= 0:
            counts[int(r["random"]), a, b] += r["n"]
    overall = counts.sum(axis=1, keepdims=True) + 0.5
    counts += PRIOR * overall / overall.sum(axis=2, keepdims=True)
    logp = np.log(counts / counts.sum(axis=2, keepdims=True))
    out = np.zeros((size + 1, size + 1))
    out[:size, :size] = np.clip(logp[1] - logp[0], -4, 4)
    return out


def ratio(model: np.ndarray, token: str) -> float:
    codes = _CODE[np.frombuffer(token.encode("ascii"), dtype=np.uint8)]
    return float(model[codes[:-1], codes[1:]].sum())


def markov_spans(text: str, model: np.ndarray, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tokens that the models take for random and that no fixed pattern has touched."""
    found = []
    for m in TOKEN.finditer(text):
        s, e = m.span()
        total = ratio(model, m.group())
        if total >= LEAST_TOTAL and total >= LEAST_MEAN * (e - s) and not any(a < e and s < b for a, _, b in taken):
            found.append((s, 3, e))
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def masked(text: str, spans, mask: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``mask``."""
    out, end = [], 0
    for s, _, e in sorted(spans):
        if s >= end:
            out += [text[end:s], mask]
        end = max(end, e)
    return "".join(out) + text[end:]


_FOUND = "n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): counts by kind, digest of the base spans, all spans.

    Offsets count code points. Null and empty texts have no spans. Rows are independent, so repeated
    rows and null ids need no rule; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0), []
            for v in batch.column(1):
                text = v.as_py() or ""
                base = base_spans(text)
                more = markov_spans(text, model, base)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, len(more), _sha(joined(base)), joined(base + more)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", *(f.split()[0] for f in _FOUND.split(", "))])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {_FOUND}")


def redact(docs: DataFrame, model: np.ndarray, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with all spans masked in ``text``, and ``length`` (if it is a column) counted anew. Nulls stay."""
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in slices(batches, at):
            old = batch.column(at).to_pylist()
            new = []
            for t in old:
                spans = base_spans(t) if t else []
                spans += markov_spans(t, model, spans) if t else []
                new.append(masked(t, spans) if spans else t)
            cols = list(batch.columns)
            cols[at] = pa.array(new, batch.schema.field(at).type)
            if length in names:
                k = names.index(length)
                was = batch.column(k).to_pylist()
                cols[k] = pa.array([n if a == b else len(b) for a, b, n in zip(old, new, was)], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def find_secrets(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``scan`` with models trained from ``docs`` itself."""
    return scan(docs, train(labelled_strings(docs, sample_docs)))
