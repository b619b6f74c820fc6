"""Quality rules by distribution divergence: Jensen-Shannon distance of a document's histograms from those of the languages, guarded by minimum lengths."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, BREAK, WORD_RE, WordHashes, drop_stored, others, stored, table, window_hashes

#: The symbols of the base rules, and the character classes of the histogram.
SYMBOLS = "#*$%&|<>"
_CLASSES = (re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[ \t]"), re.compile(r"[\n\r\x0b\x0c]"), re.compile(r"[.,;:!?'\"()\-]"))
CLASSES = ("lower", "upper", "digit", "space", "line", "point", "ascii_other", "beyond_ascii")
#: A word is common in a language from this share of the language's words on, so a language has 1 / COMMON common words at most.
COMMON = 1 / 2000

_TO_CLASS = np.full(128, 6, np.uint8)
for _i, _c in enumerate(_CLASSES):
    for _k in range(128):
        if _c.match(chr(_k)):
            _TO_CLASS[_k] = _i


def class_counts(text: str) -> np.ndarray:
    """Code points of each of CLASSES."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ascii_ = b[b < 128]
    out = np.bincount(_TO_CLASS[ascii_], minlength=8).astype(float)
    out[7] = len(text) - len(ascii_)
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence in bits, 0 to 1) of the histogram p from each row of q."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def repeated_words(hashes: np.ndarray, size: int = 8) -> int:
    """Words that lie in a window of `size` words found at least twice."""
    w = window_hashes(hashes, size)
    if len(w) < 2:
        return 0
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(w), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(hit)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base(text: str, words: list[str], hashes: np.ndarray) -> dict[str, int]:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            again += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": again, "n_repeat_words": repeated_words(hashes)}


class References:
    """Per language: the class histogram, and shares of the common words of all languages, the rest as one more bin."""

    def __init__(self, classes: dict[str, np.ndarray], words: dict[str, dict[str, float]]):
        self.langs = sorted(set(classes) & set(words))
        self.bin = {w: i for i, w in enumerate(sorted({w for s in words.values() for w in s}))}
        self.classes = np.array([classes[s] / max(1.0, classes[s].sum()) for s in self.langs])
        self.words = np.zeros((len(self.langs), len(self.bin) + 1))
        for i, s in enumerate(self.langs):
            for w, share in words[s].items():
                self.words[i, self.bin[w]] = share
            self.words[i, -1] = max(0.0, 1 - self.words[i, :-1].sum())


def _class_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sums[lang] = sums.get(lang, 0) + class_counts(text)
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()])], ["lang", "n"])


def references(docs: DataFrame, lang: str = "lang", text: str = "text") -> References:
    """Histograms over every row with a language and a text. One row per language and task is gathered for the classes; of the words, those of a share of COMMON or more."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    parts = known.mapInArrow(_class_sums, "lang string, n array<double>")
    sums = parts.select("lang", F.posexplode("n").alias("k", "n")).groupBy("lang", "k").agg(F.sum("n").alias("n")).collect()
    classes: dict[str, np.ndarray] = {}
    for r in sums:
        classes.setdefault(r.lang, np.zeros(len(CLASSES)))[r.k] = r.n
    word = known.select("lang", F.explode(F.split(F.lower("text"), BREAK)).alias("w")).where("w <> ''").groupBy("lang", "w").count()
    word = stored(word, "quality-words")
    total = word.groupBy("lang").agg(F.sum("count").alias("total"))
    counts = {r.lang: r.total for r in total.collect()}
    if not counts:
        return References({}, {})
    least = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(n * COMMON))))
    words: dict[str, dict[str, float]] = {s: {} for s in counts}
    for r in word.where(F.col("count") >= least[F.col("lang")]).collect():
        words[r.lang][r.w] = r["count"] / counts[r.lang]
    drop_stored(word)
    return References(classes, words)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, kept boolean"
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, refs: References, keep: list[str], text: Column | str = "text", most_class: float = 0.25, most_word: float = 0.57, least_chars: int = 200, least_words: int = 60) -> DataFrame:
    """The columns in keep with the base counts, both distances and the verdict.

    A distance is the least one to any language's reference. A document fails if its class histogram is further than most_class (from
    least_chars code points on) or its common-word histogram further than most_word (from least_words words on); shorter documents
    are not judged by that histogram, whose noise would decide. The thresholds lie just above the farthest of 3,196 rows labelled good (0.245 and 0.530) in the
    given tables have. Base rules: fewer than 20 words, or more than 30 of 100 words in
    repeated 8-word windows. Defined results: null or blank text has no words and fails the base rules; with no reference at all the
    distances are null and the base rules decide; an empty table gives no rows; columns in keep that are called like a result are
    replaced by it.
    """
    keep = others(keep, OUT.replace(",", "").split()[::2])
    known = docs.sparkSession.sparkContext.broadcast(refs)  # at most (languages) x (languages / COMMON) floats

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, cache = known.value, WordHashes()
        for b in batches:
            out = {k: [] for k in OUT.replace(",", "").split()[::2]}
            for t in b.column(b.num_columns - 1).to_pylist():
                t = t or ""
                words = WORD_RE.findall(t)
                found = base(t, words, cache.of(words))
                n = found["n_words"]
                bad = n < 20 or 100 * found["n_repeat_words"] > 30 * n
                far = near = None
                if r.langs and words:
                    p = class_counts(t)
                    far = float(js_distance(p / p.sum(), r.classes).min())
                    q = np.zeros(len(r.bin) + 1)
                    get = r.bin.get
                    bins = [k for w in " ".join(words).lower().split(" ") if (k := get(w)) is not None]
                    q[:-1] = np.bincount(bins, minlength=len(r.bin)) if bins else 0
                    q[-1] = max(0, n - q[:-1].sum())
                    near = float(js_distance(q / max(1.0, q.sum()), r.words).min())
                for k in _LONGS:
                    out[k].append(found[k])
                out["base_failed"].append(bad)
                out["class_distance"].append(far)
                out["word_distance"].append(near)
                out["kept"].append(not bad and not (far is not None and len(t) >= least_chars and far > most_class) and not (near is not None and n >= least_words and near > most_word))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(v, kind) for v, kind in zip(out.values(), kinds))], [*keep, *out])

    rows = docs.select(*keep, (F.col(text) if isinstance(text, str) else text).alias("_text"))
    schema = docs.select(*keep).schema
    for part in OUT.split(", "):
        schema = schema.add(*part.split(" "))
    return rows.mapInArrow(run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs), ["doc_id"])
