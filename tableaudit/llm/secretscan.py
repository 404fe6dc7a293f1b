"""Secret scan: fixed patterns, and character Markov models for the rest.

Two first-order character models are trained on labelled samples, each to one half on parts of the documents and to the other
on seeded strings, so that neither drowns the other in a corpus of any size: random strings (values that the patterns found; strings over the
usual alphabets) and ordinary identifiers (the other words of all documents; names, paths, versions and times put together from common words
and numbers). A candidate token outside the patterns' spans is a secret if its log-likelihood ratio, random against
ordinary, is high enough, in all and for each character. UUIDs are identifiers here, whatever their digits.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableaudit.llm.common import slices

# The patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}

SYMBOLS = string.ascii_letters + string.digits + "+/_=-"
#: Spans that the models may add: longer runs of SYMBOLS with a letter.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LETTER = re.compile(r"[A-Za-z]")
UUID = re.compile(r"(?i)(?:[A-Za-z_/=+-]*[_/=+-])?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}(?:[_/=+-][A-Za-z_/=+-]*)?")
#: Common words of which identifiers are made.
NAME_WORDS = """access account action active address admin agent alert amount answer archive array article asset audio author average backup batch benchmark binary bucket buffer
build button cache case category change channel chart check class clean client cluster code column comment common compare config connect content context control copy count country create
current custom data database date default delete detail device digit directory document download driver edit element email encode engine entry error event example expected export factor
field file filter folder format function general global group handler header hidden history image import index input insert instance integer internal item join key label language layer
length level library limit link list local location logger lookup manager mapping master matrix member memory message method metric model module monitor name network node normal number
object offset option order output package page parent parser password path pattern payment phone pixel point policy position prefix price process product profile project python query
queue random range reader record reference region release remote report request response result return review role route sample schema score search section segment select sequence server
service session setting shape signal simple single site size source space speed stage start state static status storage stream string structure style summary supplementary switch symbol
system table target task template test text thread time title token total track training transfer tree trigger type unique update upload user utility value vector version video view
weight width window word worker write xml zone""".split()
ALPHABETS = (string.digits + "abcdef", string.digits + "ABCDEF", string.ascii_uppercase + "234567", string.ascii_letters + string.digits,
             string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_letters, string.ascii_lowercase)

_K = len(SYMBOLS)
_CODE = np.full(256, -1, np.int64)
_CODE[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(_K)


@dataclass(frozen=True)
class Params:
    """``strings``: seeded strings of each alphabet among the random samples, and seeded identifiers of each form among the ordinary ones.
    ``least_ratio``, ``least_mean``: log-likelihood ratio (nats) of a secret, in all and for each step."""

    strings: int = 2000
    length: int = 32
    smoothing: float = 5.0
    least_ratio: float = 10.0
    least_mean: float = 0.45
    seed: int = 5


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds: 0 assign, 1 access, 2 hex; ordered."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    # A hex run that is long enough is whole: what stands before or after it isn't hex.
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


KINDS = ("assign", "access", "hex", "markov")


def steps(data: bytes) -> np.ndarray:
    """Counts of symbol pairs that stand next to each other."""
    code = _CODE[np.frombuffer(data, np.uint8)]
    pair = (code[:-1] >= 0) & (code[1:] >= 0)
    return np.bincount(code[:-1][pair] * _K + code[1:][pair], minlength=_K * _K)


def sample_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Pair counts of the labelled parts of a text: pattern values (random), the rest (ordinary)."""
    spans, random, rest, at = base_spans(text), [], [], 0
    for start, kind, end in spans:
        value = ASSIGN.match(text, start)[2] if kind == 0 else text[start:end]
        random.append(value)
        rest.append(text[at:max(at, start)])
        at = max(at, end)
    rest.append(text[at:])
    # Candidates with digits have no label yet: they train neither model. Long words without digits are mostly words.
    ordinary = CANDIDATE.sub(lambda m: " " if re.search("[0-9]", m[0]) and LETTER.search(m[0]) else m[0], " ".join(rest))
    return steps(" ".join(random).encode("utf-8", "replace")), steps(ordinary.encode("utf-8", "replace"))


def identifiers(p: Params) -> list[str]:
    """Seeded ordinary identifiers: words joined in the usual ways, with numbers, versions, dates and times."""
    rng = np.random.default_rng(p.seed)
    out = []
    for form in ("_", "-", "/", "", "camel", "upper", "time"):
        for _ in range(p.strings):
            said = [NAME_WORDS[i] for i in rng.integers(0, len(NAME_WORDS), rng.integers(2, 6))]
            number = str(rng.integers(0, 10 ** int(rng.integers(1, 5))))
            day = f"20{rng.integers(0, 40):02d}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
            clock = f"{rng.integers(0, 24):02d}{rng.integers(0, 60):02d}{rng.integers(0, 60):02d}"
            if form == "time":
                out.append([f"{day}T{clock}Z", f"{day.replace('-', '')}T{clock}Z", f"{said[0]}-{day}", f"{said[0]}_{day.replace('-', '')}_{number}", f"{number:0>4}-{number:0>6}"][rng.integers(0, 5)])
                continue
            if rng.random() < 0.5:
                said.insert(int(rng.integers(1, len(said) + 1)), [number, f"v{number}", f"{number:0>4}", day.replace("-", form if form in "_-/" else "")][rng.integers(0, 4)])
            if form == "camel":
                text = "".join(w.capitalize() for w in said)
                out.append(text if rng.random() < 0.5 else text[0].lower() + text[1:])
            else:
                text = "_".join(said).upper() if form == "upper" else form.join(said)
                out.append(f"/{text}" if form == "/" and rng.random() < 0.5 else text if rng.random() < 0.8 else "_".join(w.capitalize() for w in said))
    return out


def ratios(random: np.ndarray, ordinary: np.ndarray, p: Params) -> np.ndarray:
    """Log-likelihood ratio of each step, random against ordinary: of the means of the documents' and the seeded strings' models."""
    rng = np.random.default_rng(p.seed)
    seeded = np.zeros_like(random)
    for alphabet in ALPHABETS:
        drawn = np.array(list(alphabet))[rng.integers(0, len(alphabet), (p.strings, p.length))]
        seeded = seeded + steps(" ".join("".join(x) for x in drawn).encode())

    def model(counts: np.ndarray) -> np.ndarray:
        c = counts.reshape(_K, _K)
        single = c.sum(axis=0) + 0.5
        c = c + p.smoothing * single / single.sum()  # rare pairs fall back on how frequent the second symbol is
        return c / c.sum(axis=1, keepdims=True)

    return np.log(model(random) + model(seeded)) - np.log(model(ordinary) + model(steps(" ".join(identifiers(p)).encode())))


def train(docs: DataFrame, p: Params = Params()) -> np.ndarray:
    """Step ratios from all documents; each task sends two small tables of counts."""
    texts = docs.select("text").filter(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _K * _K), np.int64)
        for batch in slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                total += np.stack(sample_counts(text))
        label, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(step, pa.int32()), pa.array(total[label, step])], names=["label", "step", "n"])

    # At most two counts for each pair of symbols come to the driver.
    counts = texts.mapInArrow(count, "label int, step int, n bigint").groupBy("label", "step").agg(F.sum("n").alias("n"))
    total = np.zeros((2, _K * _K), np.int64)
    for r in counts.collect():
        total[r.label, r.step] = r.n
    return ratios(total[0], total[1], p)


def markov_spans(text: str, taken: list[tuple[int, int, int]], ratio: np.ndarray, p: Params) -> list[tuple[int, int, int]]:
    """(start, 3, end) of candidates that overlap no base span and look random."""
    out, at = [], 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][2] <= start:
            at += 1
        if any(s < end and e > start for s, _, e in taken[at:at + 8]) or not LETTER.search(m[0]) or UUID.fullmatch(m[0]):
            continue
        code = _CODE[np.frombuffer(m[0].encode(), np.uint8)]
        score = float(ratio[code[:-1], code[1:]].sum())
        if score >= p.least_ratio and score >= p.least_mean * (len(code) - 1):
            out.append((start, 3, end))
    return out


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of every row of ``docs``.

    Spans are in code points, end exclusive; an ``assign`` span is the whole match.
    Null and empty texts have none (the digest is that of the empty string). Repeated
    rows give equal rows; an empty table an empty result; the models then know seeded
    strings alone. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, p))
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                more = markov_spans(text or "", base, ratio, p)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(sorted(base + more)), len(more)))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),) * 2 + (pa.int64(),)))],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_markov bigint")
