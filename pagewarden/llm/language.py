"""Language of texts and of the spans inside mixed texts.

Scores are learned: character 2- and 3-grams of words, counted per language over a
bounded sample of the training rows (each task counts words first, so few rows are
shuffled). A word's
letters are looked up in script ranges, and only languages that use the script remain
candidates. Viterbi over the words' scores, with a penalty for each switch, labels the
spans; the language with most letters is the text's.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewarden.llm.common import columns_of, id_text, id_type, stored
from pagewarden.operators.ranking import top_k

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")

# First code point of each range of letters and its script (Unicode blocks)
SCRIPTS = [
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0750, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1780, "khmer"), (0x1800, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "other"),
]
STARTS = [s for s, _ in SCRIPTS]


def script(word: str) -> str:
    return SCRIPTS[max(0, bisect_right(STARTS, ord(word[0])) - 1)][1]


def grams(word: str) -> list[str]:
    """2- and 3-grams of a lower-case word with its borders; a very long word counts by all of them."""
    w = f" {word} "
    return [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]


@dataclass
class Model:
    """Log scores of n-grams per language, and the languages that use each script."""

    langs: list[str]
    rows: dict[str, int]
    scores: np.ndarray  # n-gram x language; the last row is for unknown n-grams
    scripts: dict[str, list[bool]]
    switch: float = 4.0
    floor: float = -8.0
    cache_words: int = 300_000
    key: str = ""
    _at: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None

    def word_rows(self, words: list[str]) -> np.ndarray:
        """Row of each word in the table of word scores; unknown words are scored together."""
        if self._table is None or len(self._at) + len(words) > len(self._table):
            self._at.clear()
            self._table = np.zeros((max(self.cache_words, 2 * len(words)), len(self.langs)), np.float32)
        get = self._at.get
        missing = [w for w in set(words) if w not in self._at]
        if missing:
            at, unknown, parts = self.rows, len(self.scores) - 1, [grams(w) for w in missing]
            flat = np.fromiter((at.get(g, unknown) for p in parts for g in p), np.int64)
            ends = np.cumsum([0, *map(len, parts[:-1])])
            s = np.add.reduceat(self.scores[flat], ends, axis=0)
            allowed = np.array([self.scripts.get(script(w), [True] * len(self.langs)) for w in missing])
            s = np.where(allowed, s, s.min() - 50)
            s -= s.max(axis=1, keepdims=True)
            s -= np.log(np.exp(s).sum(axis=1, keepdims=True))
            first = len(self._at)
            self._table[first : first + len(missing)] = np.maximum(s, self.floor)
            self._at.update(zip(missing, range(first, first + len(missing)), strict=True))
        return np.fromiter(map(get, words), np.int64, len(words))

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Language of each word of each text: Viterbi, all texts of the list abreast."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        starts = np.cumsum(sizes) - sizes
        at = self.word_rows([w for t in texts for w in t])
        n, k = len(at), len(self.langs)
        emit = self._table[at]
        begin, long = starts[order], sizes[order]
        active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")  # texts longer than t
        best = np.zeros(n, np.int16)
        moved = np.zeros((n, k), bool)
        value = np.zeros((len(texts), k), np.float32)
        for t, a in enumerate(active):
            rows, v = begin[:a] + t, value[:a]
            if t:
                top = v.argmax(axis=1)
                change = v[np.arange(a), top][:, None] - self.switch
                best[rows], moved[rows] = top, change > v
                v = np.maximum(v, change)
            value[:a] = v + emit[rows]
        out = np.zeros(n, np.int16)
        state = value.argmax(axis=1) if len(texts) else np.zeros(0, int)
        for t in range(len(active) - 1, -1, -1):
            a = active[t]
            rows, s = begin[:a] + t, state[:a]
            out[rows] = s
            if t:
                state[:a] = np.where(moved[rows, s], best[rows], s)
        return [out[b : b + s] for b, s in zip(starts, sizes, strict=True)]


_WARM: dict[str, Model] = {}


def _warm(model: Model) -> Model:
    """The copy of the model that this Python worker has used before, with its word scores."""
    if model.key not in _WARM:
        _WARM.clear()
        _WARM[model.key] = model
    return _WARM[model.key]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, what, n) of each task: n-grams and scripts, from counts of words."""
    words: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        out: Counter = Counter()
        for lang, counts in words.items():
            for w, n in counts.items():
                out[(lang, "script", script(w))] += n * len(w)
                for g in grams(w):
                    out[(lang, "gram", g)] += n
        words.clear()
        keys = list(out)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(out.values(), pa.int64())],
            names=["lang", "kind", "what", "n"],
        )

    for batch in batches:
        for lang, text in zip(*columns_of(batch, "lang", "text"), strict=True):
            words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        if sum(map(len, words.values())) > 150_000:
            yield rows()
    if words:
        yield rows()


def quotas(sizes: dict[str, int], most: int) -> dict[str, int]:
    """Texts to take of each language: small ones whole, the others an equal share of the rest."""
    out, left, rest = {}, most, len(sizes)
    for lang, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        out[lang] = min(n, left // rest)
        left, rest = left - out[lang], rest - 1
    return out


def sample(rows: DataFrame, max_rows: int, max_langs: int) -> DataFrame:
    """About ``max_rows`` distinct texts of ``rows`` (lang, text), by a hash of the text, shared
    among the languages by ``quotas``; a text that many rows repeat is one."""
    placed = rows.withColumn("at", F.xxhash64("text"))
    sizes = {r.lang: r.n for r in placed.select("lang", "at").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(max_langs + 1).collect()}
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages: raise max_langs, which bounds the model")
    wide = 1 << 30
    shares = {lang: -(-wide * n // sizes[lang]) for lang, n in quotas(sizes, max_rows).items()}
    below = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(share)) for lang, share in shares.items()]) if shares else F.lit(0)
    taken = placed.filter(F.pmod("at", F.lit(wide)) < below)
    return taken.groupBy("lang", "at").agg(F.first("text").alias("text")).select("lang", "text")


def fit(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_rows: int = 50_000, max_grams: int = 200_000, max_langs: int = 400,
    min_script_share: float = 0.01, switch: float = 4.0,
) -> Model:
    """Learn from rows whose language and text are not null.

    The model is learned from a bounded sample: about ``max_rows`` distinct texts, small
    languages whole, the others in equal shares. Every language takes part; more than
    ``max_langs`` are an error. The most frequent n-grams of each language are kept, the
    same number for each, ``max_grams`` together. A script belongs to a language that writes
    at least ``min_script_share`` of its letters in it. Without training rows the model has
    no languages and every text is undetermined.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    rows = stored(sample(rows, max_rows, max_langs), "language-sample")
    counted = rows.mapInArrow(_count, "lang string, kind string, what string, n bigint").groupBy("lang", "kind", "what").agg(F.sum("n").alias("n"))
    counted = stored(counted, "language-counts")
    by_script = counted.filter("kind = 'script'").select("lang", "what", "n").collect()
    langs = sorted({r.lang for r in by_script})
    found = counted.filter("kind = 'gram'")
    best = top_k(found, ["lang"], [F.desc("n"), F.col("what")], max_grams // max(1, len(langs)))
    counts = found.join(best.select("what").distinct(), "what", "left_semi").select("lang", "what", "n").collect()
    column = {lang: i for i, lang in enumerate(langs)}
    at: dict[str, int] = {}
    for r in counts:
        at.setdefault(r.what, len(at))
    table = np.zeros((len(at) + 1, len(langs)))
    for r in counts:
        table[at[r.what], column[r.lang]] = r.n
    if langs:
        table = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))
    letters = Counter()
    for r in by_script:
        letters[r.lang] += r.n
    scripts: dict[str, list[bool]] = {}
    for r in by_script:
        if r.n >= min_script_share * letters[r.lang]:
            scripts.setdefault(r.what, [False] * len(langs))[column[r.lang]] = True
    return Model(langs, at, table, scripts, switch, key=uuid.uuid4().hex)


def _spans(labels: np.ndarray, words: list[str], langs: list[str]) -> list[dict]:
    cut = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [
        {"lang": langs[labels[a]], "first_word": a, "words": b - a, "letters": sum(map(len, words[a:b]))}
        for a, b in zip(cut, cut[1:], strict=False)
    ]


SPAN = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("letters", pa.int64())]))


def _predictor(fitted: Model, with_spans: bool, words_at_once: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _warm(fitted)
        for batch in batches:
            (texts,) = columns_of(batch, "text")
            preds, scores, spans = [], [], []
            held: list[list[str]] = []

            def flush() -> None:
                size = [np.fromiter(map(len, w), np.int64, len(w)) for w in held]
                for words, letters, labels in zip(held, size, model.label(held) if model.langs else [None] * len(held), strict=True):
                    if not words or labels is None:
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
                        spans.append([])
                        continue
                    share = np.bincount(labels, letters, len(model.langs))
                    top = int(share.argmax())
                    preds.append(model.langs[top])
                    scores.append(float(share[top] / letters.sum()))
                    if with_spans:
                        spans.append(_spans(labels, words, model.langs))
                held.clear()

            n = 0
            for text in texts:
                held.append(WORD.findall(text.lower()))
                n += len(held[-1])
                if n >= words_at_once:
                    flush()
                    n = 0
            flush()
            columns = [batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            names = ["doc_id", "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, SPAN))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def predict(
    docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = True, words_at_once: int = 400_000,
) -> DataFrame:
    """Language of every whole text, with its spans when asked for.

    ``lang_pred`` is a learned language (the first in order on a tie), ``und`` where the
    text is null or has no letter or nothing was learned; ``score`` is the share of the
    text's letters that lie in spans of that language (0 for ``und``). Repeated rows get a
    row each; ids may be null; an empty table gives no rows.
    """
    spans = ", spans array<struct<lang:string,first_word:bigint,words:bigint,letters:bigint>>" if with_spans else ""
    schema = f"doc_id {id_type(docs, id_col)}, lang_pred string, score double{spans}"
    return id_text(docs, id_col, text_col).mapInArrow(_predictor(model, with_spans, words_at_once), schema)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text", min_score: float = 0.5, words_at_once: int = 400_000) -> DataFrame:
    """The rows, with all their columns, of which a learned language holds at least the
    share ``min_score`` of the letters. Null texts and texts without letters go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = _predictor(model, False, words_at_once)
        for batch in batches:
            texts = pa.array([t or "" for t in columns_of(batch, text_col)[0]], pa.string())
            (found,) = label(iter([pa.RecordBatch.from_arrays([texts, texts], names=["doc_id", "text"])]))
            keep = [p != UNDETERMINED and s >= min_score for p, s in zip(*columns_of(found, "lang_pred", "score"), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
