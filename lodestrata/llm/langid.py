"""Language identification by hierarchical discrimination: family first, then one-versus-one linear support vector machines within it."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, others, stored, table

DIMS = 4096
#: Families of common languages by ISO 639-1 code; a language of none of these is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi fo", "romance": "fr es it pt ro ca gl oc la", "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu", "baltic": "lt lv", "celtic": "ga cy gd br", "turkic": "tr az kk uz ky tk", "indic": "hi bn mr ne ur gu pa", "semitic": "ar he am mt",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = regex.compile(r"\p{L}")
_OTHER = re.compile(r"[\W\d_]+")


def family(lang: str) -> str:
    return _FAMILY.get(re.split(r"[-_]", lang.lower())[0], "only:" + lang)


def grams(text: str | None) -> np.ndarray | None:
    """Counts of hashed byte 1- to 4-grams of the whole lower-cased text with all but letters as one space. None where there is no letter."""
    if not text or not _LETTER.search(text):
        return None
    b = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    total = np.zeros(DIMS)
    code = b.copy()
    for n in range(1, 5):
        if n > 1:
            if len(b) < n:
                break
            code = (code[:-1] << np.uint32(8)) | b[n - 1 :]
        total += np.bincount(((code ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)) >> np.uint32(20), minlength=DIMS)
    return total


def features(total: np.ndarray) -> np.ndarray:
    """Root frequencies, of unit length."""
    out = np.sqrt(total)
    return out / np.linalg.norm(out)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 200) -> np.ndarray:
    """Linear support vector machine, squared hinge loss: accelerated gradient descent on x (with a column of ones) and y in {-1, 1}, classes weighed alike. x is multiplied in its own precision, without a copy."""
    w = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * 100
    rate = 1 / (1 + 2 * w.sum() * 2)
    v = at = np.zeros(x.shape[1])
    for k in range(steps):
        gap = np.maximum(0, 1 - y * (x @ at.astype(x.dtype)))
        new = at - rate * (at - 2 * x.T @ (w * y * gap).astype(x.dtype))
        at, v = new + k / (k + 3) * (new - v), new
    return v


#: The likeness of a language to its own texts is measured by this share of them, and a text may fall short of theirs by TIMES as much; from FULL grams on a text's length makes it no surer.
SHARE, TIMES, FULL = 0.98, 2.0, 2000


class Model:
    """families: names; top: one machine per family against the rest; pairs: {(a, b): machine}, positive for a; typical: per language the logarithm of each gram's share, the mean of it over a gram of the language's texts, and how far these stray."""

    def __init__(self, counts: np.ndarray, langs: list[str]):
        """counts: a text's grams in float32 and an empty column for the constant; they are used up."""
        total = counts.sum(1, dtype=float)
        self.langs = sorted(set(langs))
        self.families = sorted({family(s) for s in self.langs})
        of = np.array([self.families.index(family(s)) for s in langs])
        self.within = {f: [s for s in self.langs if family(s) == f] for f in self.families}
        langs = np.array(langs)
        self.pairs, self.typical = {}, {}
        # this runs in the driver: one matrix of single precision for all texts, and a language's or a pair's own beside it
        x = counts
        x /= total[:, None]
        for s in self.langs:
            n = total[langs == s]
            each = x[langs == s, :DIMS].astype(float)  # shares
            share = each.mean(0) + 0.1 / DIMS
            log = np.log(share / share.sum())
            each = each @ log
            mean = float(each.mean())
            self.typical[s] = log, mean, TIMES * float(np.quantile(np.maximum(0, mean - each) * np.sqrt(np.minimum(n, FULL)), SHARE))
        np.sqrt(x, out=x)
        x[:, DIMS] = 1
        self.top = np.array([fit_svm(x, np.where(of == i, 1.0, -1.0)) for i in range(len(self.families))]) if len(self.families) > 1 else None
        for members in self.within.values():
            for a, b in itertools.combinations(members, 2):
                rows = (langs == a) | (langs == b)
                self.pairs[a, b] = fit_svm(x[rows], np.where(langs[rows] == a, 1.0, -1.0))

    def predict(self, counts: np.ndarray) -> tuple[str, float, float]:
        """Language, score and likeness. Score: the share of the family's margin, times the mean share of the winner's duels. Likeness: how far the text's grams are above the least that the language's own texts of that length reach; below 0 the text isn't in that language, nor in any other that was learned."""
        x, sure, best = np.append(features(counts), 1.0), 1.0, 0
        if self.top is not None:
            margins = self.top @ x
            best = int(margins.argmax())
            p = 1 / (1 + np.exp(-2 * margins))
            sure = float(p[best] / p.sum())
        members = self.within[self.families[best]]
        won = dict.fromkeys(members, 0.0)
        for a, b in itertools.combinations(members, 2):
            p = float(1 / (1 + np.exp(-2 * (self.pairs[a, b] @ x))))
            won[a] += p
            won[b] += 1 - p
        lang = max(members, key=lambda s: (won[s], s))
        log, mean, stray = self.typical[lang]
        n = counts.sum()
        like = float(counts @ log / n - mean + stray / np.sqrt(min(n, FULL)))
        return lang, min(1.0, max(0.0, sure * (won[lang] / (len(members) - 1) if len(members) > 1 else 1.0))), like


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (x := grams(text)) is not None:
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([at.astype(np.uint16).tobytes()]), pa.array([x[at].astype(np.float32).tobytes()])], ["lang", "at", "x"])


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows with one (lang, r) the first of a task."""
    seen = set()
    for b in batches:
        new = [k not in seen and not seen.add(k) for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        yield b.filter(pa.array(new, pa.bool_()))


def draw(known: DataFrame, per_lang: int) -> list:
    """(lang, r) of the per_lang different texts (all, if there are fewer) of each language with the smallest hashes r. Copies of a text count once."""
    texts = stored(known.select("lang", "r").distinct(), "langid-texts")
    counts = {row[0]: row[1] for row in texts.groupBy("lang").count().collect()}  # one row per language
    # some more than asked for, so that chance leaves no language short; if it does, twice as many
    most, found, short = per_lang + 8 * per_lang**0.5 + 20, {}, list(counts)
    while short:
        share = F.create_map(*(x for k in short for x in (F.lit(k), F.lit(min(2**63 - 1, int(most / counts[k] * 2**63))))))
        found |= {k: [] for k in short}
        for row in texts.where(F.col("lang").isin(short)).where(F.col("r") <= share[F.col("lang")]).collect():
            found[row[0]].append(row[1])
        short, most = [k for k in short if len(found[k]) < min(per_lang, counts[k])], 2 * most
    drop_stored(texts)
    return [(k, r) for k in sorted(found) for r in sorted(found[k])[:per_lang]]


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", per_lang: int = 600) -> Model | None:
    """Learn from a bounded sample of the rows with a language: per_lang different texts of each, those with the smallest hashes. None if there is nothing to learn from."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), F.shiftrightunsigned(F.xxhash64(F.lit("langid"), F.col(text)), 1).alias("r"), F.col(text).alias("text"))
    drawn = draw(known, per_lang)
    if not drawn:
        return None
    sample = F.broadcast(docs.sparkSession.createDataFrame(drawn, "lang string, r long"))  # per_lang rows a language
    rows = known.join(sample, ["lang", "r"], "left_semi").mapInArrow(_once, known.schema).dropDuplicates(["lang", "r"]).select("text", "lang").mapInArrow(_vectors, "lang string, at binary, x binary")
    counts, langs = np.zeros((len(drawn), DIMS + 1), np.float32), []
    # in the order of the texts' grams, whatever task sends them
    got = sorted(rows.collect(), reverse=True)
    while got:
        r = got.pop()
        counts[len(langs), np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.x, np.float32)
        langs.append(r.lang)
    return Model(counts[: len(langs)], langs) if langs else None


OUT = ["lang_pred", "score", "likeness"]


def identify(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (the columns in keep, or all) with lang_pred, score (0 to 1) and likeness (below 0: not like the texts of that language), from the whole text.

    Defined results: null text, text without a letter, and everything where nothing could be learned: `und`, score 0, likeness 0. Equal
    texts get equal results; languages with equal scores: the last by name; an empty table gives no rows; input columns called like a
    result are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats for each language, family and pair of related languages
    names = others(keep if keep is not None else docs.columns, OUT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for b in batches:
            found = []
            for t in b.column(b.num_columns - 1).to_pylist():
                x = grams(t) if m else None
                found.append(("und", 0.0, 0.0) if x is None else m.predict(x))
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], [*names, *OUT])

    rows = docs.select(*names, F.col(text).alias("_text"))
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("likeness", "double")
    return rows.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit(docs.where(F.coalesce(~held, F.lit(False))).select("text", "lang"))
    return identify(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), model, keep=["doc_id", "held_out"])
