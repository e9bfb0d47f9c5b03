"""Languages of documents and of their segments: n-gram likelihoods and mixture inference per document."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.session import cut_lineage

# Two-letter code, three-letter codes and English name of languages.
LANGUAGES = (
    ("af", "afr", "afrikaans"), ("ar", "ara", "arabic"), ("az", "aze", "azerbaijani"), ("be", "bel", "belarusian"), ("bg", "bul", "bulgarian"),
    ("bn", "ben", "bengali"), ("bs", "bos", "bosnian"), ("ca", "cat", "catalan"), ("cs", "ces", "cze", "czech"), ("cy", "cym", "wel", "welsh"),
    ("da", "dan", "danish"), ("de", "deu", "ger", "german"), ("el", "ell", "gre", "greek"), ("en", "eng", "english"), ("es", "spa", "spanish"),
    ("et", "est", "estonian"), ("eu", "eus", "baq", "basque"), ("fa", "fas", "per", "persian"), ("fi", "fin", "finnish"), ("fr", "fra", "fre", "french"),
    ("ga", "gle", "irish"), ("gl", "glg", "galician"), ("he", "heb", "hebrew"), ("hi", "hin", "hindi"), ("hr", "hrv", "croatian"),
    ("hu", "hun", "hungarian"), ("hy", "hye", "arm", "armenian"), ("id", "ind", "indonesian"), ("is", "isl", "ice", "icelandic"), ("it", "ita", "italian"),
    ("ja", "jpn", "japanese"), ("ka", "kat", "geo", "georgian"), ("kk", "kaz", "kazakh"), ("ko", "kor", "korean"), ("la", "lat", "latin"),
    ("lt", "lit", "lithuanian"), ("lv", "lav", "latvian"), ("mk", "mkd", "mac", "macedonian"), ("mn", "mon", "mongolian"), ("ms", "msa", "may", "malay"),
    ("mt", "mlt", "maltese"), ("nl", "nld", "dut", "dutch"), ("no", "nor", "norwegian"), ("pl", "pol", "polish"), ("pt", "por", "portuguese"),
    ("ro", "ron", "rum", "romanian"), ("ru", "rus", "russian"), ("sk", "slk", "slo", "slovak"), ("sl", "slv", "slovenian"), ("sq", "sqi", "alb", "albanian"),
    ("sr", "srp", "serbian"), ("sv", "swe", "swedish"), ("sw", "swa", "swahili"), ("ta", "tam", "tamil"), ("te", "tel", "telugu"), ("th", "tha", "thai"),
    ("tr", "tur", "turkish"), ("uk", "ukr", "ukrainian"), ("ur", "urd", "urdu"), ("uz", "uzb", "uzbek"), ("vi", "vie", "vietnamese"), ("zh", "zho", "chi", "chinese"),
)

#: Hash buckets of each n-gram order, and the orders.
BUCKETS, ORDERS = 1 << 16, 3
#: Labelled documents of a language that the model is fitted on, at most in expectation.
SAMPLE_PER_LANGUAGE = 400
#: Letters (of scripts without blanks) that a whole sentence has at least.
MIN_LETTERS, MIN_IDEOGRAPHS = 25, 8
#: Log likelihood that a further language must win in a document, besides half the logarithm of its sentences.
PENALTY = 12.0
#: n-grams scored at a time, so that one long text needs no more memory than many short ones.
PIECE = 400_000

_ENDS = re.compile(r"(?<=[.!?])\s+(?=[^\sa-zà-ÿа-я])|(?<=[。！？])")


def language_of(label: str) -> Column:
    """Two-letter code that a label names, by code (with or without a country) or English name; NULL for any other."""
    head = F.regexp_extract(F.lower(F.trim(F.col(label))), r"^([a-z]+)(?:[-_][a-z0-9]{2,4})?$", 1)
    codes = F.create_map(*[F.lit(x) for code, *names in LANGUAGES for name in (code, *names) for x in (name, code)])
    return F.try_element_at(codes, head)


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the lower-case letter, or a blank for all else; and whether it is an ideograph."""
    lower = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    wide = np.zeros(sys.maxunicode + 1, dtype=bool)
    for a, b in ((0x2E80, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)):  # Fixed values: CJK blocks
        wide[a:b] = True
    return lower, wide & (lower != 32)


def sentences(text: str) -> list[str]:
    """Sentences, claims and headings in order. Lines that were only wrapped are joined before splitting."""
    units, held = [], ""
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            if held:
                units.append(held)
            held = ""
            continue
        if held and (held[-1] in ".!?。！？:;：；" or (len(held) < 45 and not line[0].islower())):
            units.append(held)
            held = ""
        if not held:
            held = line
        elif held[-1] == "-" and line[0].islower():
            held = held[:-1] + line
        else:
            held = f"{held} {line}"
    if held:
        units.append(held)
    return [s for u in units for s in _ENDS.split(u) if s]


def _ngrams(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket numbers of the n-grams that begin at each position but the last two."""
    a, b, c = codes[:-2].astype(np.uint64), codes[1:-1].astype(np.uint64), codes[2:].astype(np.uint64)
    mix = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)
    yield mix(a)
    yield mix(a << np.uint64(21) | b) + BUCKETS
    yield mix((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c) + 2 * BUCKETS


def _prepared(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters of the joined parts, where each part begins, how many letters it has, and whether it is a whole sentence."""
    lower, wide = _letters()
    raw = np.frombuffer("\n".join([*parts, "\n"]).encode("utf-32-le", "replace"), dtype=np.uint32)
    starts = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
    codes = lower[raw]
    letters = np.add.reduceat(codes != 32, starts)
    ideographs = np.add.reduceat(wide[raw], starts)
    return codes, starts, letters, (letters >= MIN_LETTERS) | (ideographs >= MIN_IDEOGRAPHS)


def _scores(codes: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log likelihood of each part under each language (the mean of the orders)."""
    out = np.zeros((len(starts), weights.shape[1]))
    last = len(codes) - 2
    for at in range(0, last, PIECE):
        piece = codes[at : min(at + PIECE, last) + 2]
        first = np.searchsorted(starts, at, "right") - 1
        inner = starts[first : np.searchsorted(starts, at + len(piece) - 2)]
        cuts = np.maximum(inner - at, 0)
        keep = piece[:-2] != 32
        total = np.zeros((len(piece) - 2, weights.shape[1]), dtype=np.float32)
        for grams in _ngrams(piece):
            total += weights[grams]
        total[~keep] = 0
        out[first : first + len(cuts)] += np.add.reduceat(total, cuts, axis=0)
    return out / ORDERS


def _mixture(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, posteriors) of one document's sentences.

    Expectation-maximisation of the language proportions; then languages leave, the cheapest first, as long as the
    document's log likelihood falls by less than the penalty.
    """

    def fit(use: list[int]) -> tuple[float, np.ndarray]:
        own = scores[:, use]
        share = np.full(len(use), 1 / len(use))
        for _ in range(12):
            joint = own + np.log(share + 1e-9)
            top = joint.max(1, keepdims=True)
            post = np.exp(joint - top)
            norm = post.sum(1, keepdims=True)
            post /= norm
            share = post.mean(0)
        return float((top[:, 0] + np.log(norm[:, 0])).sum()), post

    use = sorted(set(scores.argmax(1)))
    value, post = fit(use)
    penalty = PENALTY + 0.5 * np.log(len(scores))
    while len(use) > 1:
        trials = [(fit([x for x in use if x != leave]), leave) for leave in use]
        (best, its), leave = max(trials, key=lambda x: x[0][0])
        if value - best >= penalty:
            break
        use = [x for x in use if x != leave]
        value, post = best, its
    return np.array(use), post


def _confidence(scores: np.ndarray, letters: int, chosen: int | None = None) -> float:
    """Posterior of the chosen (or likeliest) language, tempered by the square root of the letters.

    n-grams of one text say much the same, so their summed log likelihoods would make any long text certain; as if
    only the root of the letters were independent, a clear text still comes near 1 and a doubtful one does not.
    """
    post = np.exp((scores - scores.max()) / np.sqrt(max(letters, 1)))
    return float(post[scores.argmax() if chosen is None else chosen] / post.sum())


class LanguageModel:
    """Log probabilities of hashed n-grams per language."""

    def __init__(self, languages: list[str], counts: np.ndarray, smoothing: float = 0.3) -> None:
        self.languages = languages
        weights = np.empty((ORDERS * BUCKETS, len(languages)), dtype=np.float32)
        for k in range(ORDERS):
            own = counts[k * BUCKETS : (k + 1) * BUCKETS] + smoothing
            weights[k * BUCKETS : (k + 1) * BUCKETS] = np.log(own / own.sum(0))
        self.weights = weights

    def segments(self, text: str | None) -> list[tuple[str, float, int]]:
        return self.batch([text])[0]

    def batch(self, texts: list[str | None]) -> list[list[tuple[str, float, int]]]:
        """(language, confidence, whole sentences) of the segments of each text.

        A text without a whole sentence has one segment of 0 sentences, with the likeliest language of its letters;
        a text without letters has none.
        """
        if not self.languages:
            return [[] for _ in texts]
        out, group, size = [], [], 0
        for text in texts:
            parts = sentences(text) if text else []
            group.append(parts)
            size += sum(map(len, parts))
            if size > PIECE:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, group: list[list[str]]) -> list[list[tuple[str, float, int]]]:
        parts = [p for x in group for p in x]
        if not parts:
            return [[] for _ in group]
        codes, starts, size, whole = _prepared(parts)
        scores = _scores(codes, starts, self.weights)
        best = scores.argmax(1)
        out, at = [], 0
        for x in group:
            part = slice(at, at + len(x))
            at += len(x)
            out.append(self._document(scores[part], size[part], whole[part], best[part]))
        return out

    def _document(self, scores: np.ndarray, size: np.ndarray, whole: np.ndarray, best: np.ndarray) -> list[tuple[str, float, int]]:
        if not whole.any():
            total = scores.sum(0) if len(scores) else np.zeros(1)
            if not total.any():
                return []
            return [(self.languages[int(total.argmax())], _confidence(total, size.sum()), 0)]
        scores, best = scores[whole], best[whole]
        if (best == best[0]).all():
            return [(self.languages[int(best[0])], _confidence(scores.sum(0), size[whole].sum()), len(scores))]
        use, post = _mixture(scores)
        own = use[post.argmax(1)]
        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        ends = np.r_[cuts[1:], len(own)]
        letters = size[whole]
        return [(self.languages[int(own[a])], _confidence(scores[a:b].sum(0), letters[a:b].sum(), int(own[a])), int(b - a)) for a, b in zip(cuts, ends)]


def fit_languages(df: DataFrame, text: str, label: str, *, key: str, sample: int = SAMPLE_PER_LANGUAGE, rounds: int = 2, min_documents: int = 2) -> LanguageModel:
    """A model fitted on at most ``sample`` labelled documents of each language, in expectation.

    The sample is drawn by a hash of ``key`` at a rate that the label's count sets, and is read whole. n-gram counts
    are summed on Spark; only the table of counts, of fixed size, comes to the driver. Without labelled documents the
    model knows no language and finds no segments. As labels may be wrong and
    documents mixed, each further round counts sentences under the language that the last model gives them.
    """
    labelled = df.select(F.col(text).alias("text"), language_of(label).alias("lang"), F.xxhash64(F.col(key)).alias("h")).where("lang is not null and length(text) > 0")
    known = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] >= min_documents}
    languages = sorted(known)
    if not known:
        return LanguageModel(languages, np.zeros((ORDERS * BUCKETS, 0)))
    rates = F.create_map(*[F.lit(x) for lang, n in known.items() for x in (lang, sample / n * 1_000_000)])
    chosen = cut_lineage(labelled.where(F.pmod("h", F.lit(1_000_000)) < F.try_element_at(rates, "lang")).select("text", "lang"))  # read once a round
    model = None
    for _ in range(rounds + 1):
        rows = chosen.mapInPandas(_counter(languages, model), "lang int, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((ORDERS * BUCKETS, len(languages)))
        counts[rows["gram"], rows["lang"]] = rows["n"]
        model = LanguageModel(languages, counts)
    return model


def _counter(languages: list[str], model: LanguageModel | None):  # noqa: ANN202
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(languages), ORDERS * BUCKETS), dtype=np.int64)
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"]):
                parts = sentences(text)
                if not parts or lang not in place:
                    continue
                codes, starts, _, whole = _prepared(parts)
                own = np.full(len(parts), place[lang]) if model is None else _scores(codes, starts, model.weights).argmax(1)
                ends = np.r_[starts[1:], len(codes) - 2]
                for i in range(len(languages)):
                    mask = (own == i) & whole
                    if mask.any():
                        keep = np.repeat(mask, ends - starts)[: len(codes) - 2] & (codes[:-2] != 32)[: (ends - starts).sum()]
                        for grams in _ngrams(codes):
                            totals[i] += np.bincount(grams[: len(keep)][keep], minlength=ORDERS * BUCKETS)
        lang, gram = np.nonzero(totals)
        yield pd.DataFrame({"lang": lang.astype(np.int32), "gram": gram.astype(np.int32), "n": totals[lang, gram]})

    return count


def language_segments(df: DataFrame, row_id: str, text: str, model: LanguageModel) -> DataFrame:
    """row_id, segment (from 1), lang, confidence, n_sentences: the segments of each document in order.

    Null, empty and letterless texts have no segment. Every text is read whole; nothing is shuffled.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = shared.value.batch(list(pdf.iloc[:, 1]))
            rows = [(i, k, *s) for i, own in zip(pdf.iloc[:, 0], found) for k, s in enumerate(own, 1)]
            yield pd.DataFrame(rows, columns=[row_id, "segment", "lang", "confidence", "n_sentences"])

    rows = df.select(row_id, F.col(text).alias("text"))
    return rows.where("text is not null").mapInPandas(run, f"`{row_id}` {dict(rows.dtypes)[row_id]}, segment int, lang string, confidence double, n_sentences int")


def document_languages(segments: DataFrame, row_id: str) -> DataFrame:
    """row_id, lang, confidence, share, n_languages: the language with the most sentences of each document.

    Ties go to the first language in text order. A language counts where two sentences in a row are written in it; a
    document without such a run takes the likeliest language.
    """
    per = segments.groupBy(row_id, "lang").agg(
        F.sum("n_sentences").alias("s"), F.max("n_sentences").alias("longest"), (F.sum(F.col("confidence") * F.greatest("n_sentences", F.lit(1))) / F.sum(F.greatest("n_sentences", F.lit(1)))).alias("confidence")
    )
    first = F.min_by(F.struct("lang", "confidence", "s"), F.struct(-F.col("s"), F.col("lang")))
    best = per.groupBy(row_id).agg(first.alias("b"), F.sum("s").alias("all"), F.count_if(F.col("longest") >= 2).alias("n_languages"))
    share = F.when(F.col("all") > 0, F.col("b.s") / F.col("all")).otherwise(1.0)
    return best.select(row_id, "b.lang", "b.confidence", share.alias("share"), "n_languages")
